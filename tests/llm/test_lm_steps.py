import numpy as np

from fluora.llm import lm_scoring


def _model(n: int = 300) -> lm_scoring.Model:
    own = [(f"w{i}", 1000 - i) for i in range(n)]
    rest = {k: (50 + k, 5) for k in range(lm_scoring.LASTS)}
    return lm_scoring.Model(lm_scoring.Lexicon(own, [], 40, rest, 0.5))


def test_scores_do_not_depend_on_how_tokens_are_cut(monkeypatch):
    """Tokens are scored in order of item, in lots; each has the probability of brute force, in its own place."""
    model, rng = _model(), np.random.default_rng(2)
    ids = rng.integers(0, len(model.group), 700)
    starts = np.array([0, 1, 90, 400])
    want = model.log_probs(ids, starts)
    before = lm_scoring.contexts(ids, starts, model.end)
    for i in (0, 1, 5, 90, 399, 699):
        made = sum(model.c[j] * model.r[before[i, j]] for j in range(lm_scoring.CONTEXT))
        groups, same = np.exp(made @ model.gq.T + model.gb), np.flatnonzero(model.group == model.group[ids[i]])
        items = np.exp(made @ model.q[same].T + model.b[same])
        p = groups[model.group[ids[i]]] / groups.sum() * items[list(same).index(ids[i])] / items.sum()
        assert np.isclose(10.0 ** want[i], p, rtol=1e-3)
    for chunk, rows in ((64, 7), (1 << 17, 1)):
        monkeypatch.setattr(lm_scoring, "CHUNK", chunk)
        monkeypatch.setattr(lm_scoring, "ROWS", rows)
        assert np.allclose(model.log_probs(ids, starts), want, atol=1e-4)


def test_a_lot_is_scored_group_by_group(monkeypatch):
    """A group's items are looked up once for a lot, not once for every few thousand tokens."""
    model, calls = _model(), []
    taken = lm_scoring._taken
    monkeypatch.setattr(lm_scoring, "_taken", lambda *x: calls.append(1) or taken(*x))
    ids = np.random.default_rng(1).integers(0, 300, 40_000)
    model.log_probs(ids, np.array([0]))
    assert len(calls) <= 2 * model.words + 40_000 // 2048 + 1  # a group has about 2,350 tokens, so two pieces
