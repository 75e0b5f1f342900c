"""Linear-chain conditional random fields in numpy.

Features factor through forms: every token has a form (an entry of a table of distinct
token spellings), and slots point from a token to the forms that describe it (itself, its
neighbours, the starts of the chunks around). A slot's weights are summed once per form
into a score table, so the emissions of a batch are a few table look-ups, and the cost of
feature extraction depends on the number of distinct forms alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

FORBIDDEN = -1e4


def padded(lengths: np.ndarray, cells: int = 400_000):
    """Batches of sequence numbers of like length, at most about ``cells`` padded tokens each."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        # the longest of the batch bounds its padded size
        n = max(1, min(len(order) - at, cells // max(1, int(lengths[order[at]]))))
        while n > 1 and n * int(lengths[order[at + n - 1]]) > cells:
            n = max(1, cells // int(lengths[order[at + n - 1]]))
        yield order[at : at + n]
        at += n


def lay_out(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` of the sequences as [time, sequence, label], and the flat index of each cell."""
    t = np.arange(int(lengths.max()))[:, None]
    index = starts[None, :] + np.minimum(t, lengths[None, :] - 1)
    return values[index], index


def forward_backward(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Marginals [time, sequence, label], expected transitions [label, label] and log likelihood norm.

    Scaled to one at each step; cells past a sequence's end are zero.
    """
    steps, n, k = e.shape
    top = e.max(axis=2)
    psi = np.exp(e - top[:, :, None])
    a, into, out = np.exp(trans), np.exp(first), np.exp(last)
    alpha, scale = np.empty_like(psi), np.ones((steps, n), psi.dtype)
    for t in range(steps):
        x = psi[t] * (into if t == 0 else alpha[t - 1] @ a)
        ends = lengths == t + 1
        if ends.any():
            x[ends] *= out
        scale[t] = x.sum(axis=1)
        alpha[t] = x / scale[t][:, None]
    inside = np.arange(steps)[:, None] < lengths[None, :]
    norm = float((np.log(scale) + top)[inside].sum())
    beta = np.ones((n, k), psi.dtype)
    post = np.zeros_like(psi)
    pairs = np.zeros((k, k), np.float64)
    for t in range(steps - 1, -1, -1):
        here = inside[t]
        post[t][here] = alpha[t][here] * beta[here]
        if t:
            x = psi[t] * beta / scale[t][:, None]
            ends = lengths == t + 1
            if ends.any():
                x[ends] *= out
            x[~here] = 0
            pairs += alpha[t - 1].T.astype(np.float64) @ x
            beta = np.where(here[:, None], x @ a.T, beta)
    return post, pairs * a, norm


def viterbi(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Best labels [time, sequence]; cells past a sequence's end are undefined."""
    steps, n, k = e.shape
    back = np.empty((steps, n, k), np.int8)
    score = e[0] + first
    final = np.empty((n, k), e.dtype)
    done = lengths == 1
    final[done] = score[done] + last
    for t in range(1, steps):
        x = score[:, :, None] + trans[None]
        back[t] = x.argmax(axis=1)
        score = np.take_along_axis(x, back[t][:, None, :].astype(np.intp), 1)[:, 0] + e[t]
        done = lengths == t + 1
        if done.any():
            final[done] = score[done] + last
    path = np.empty((steps, n), np.int8)
    at = final.argmax(axis=1)
    rows = np.arange(n)
    for t in range(steps - 1, -1, -1):
        here = t < lengths
        path[t] = at
        if t:
            at = np.where(here & (t <= lengths - 1), back[t, rows, at], at)
    return path


class Model:
    """Weights of slots, transitions and the names of features and labels."""

    def __init__(self, labels: Sequence[str], names: dict[str, int], weights: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.labels, self.names, self.weights = list(labels), names, weights
        self.trans, self.first, self.last = trans, first, last

    def tables(self, features: Sequence[Sequence[str]]) -> np.ndarray:
        """Score tables [slot, form, label] of forms given by their features; unknown features count nothing."""
        ids = [[j for f in fs if (j := self.names.get(f)) is not None] for fs in features]
        out = np.zeros((self.weights.shape[0], len(ids), self.weights.shape[2]), np.float32)
        for i, js in enumerate(ids):
            if js:
                out[:, i] = self.weights[:, js].sum(axis=1)
        return out


def train(
    features: Sequence[Sequence[str]],
    slots: np.ndarray,
    gold: np.ndarray,
    starts: np.ndarray,
    lengths: np.ndarray,
    labels: Sequence[str],
    forbidden: Callable[[str, str], bool] | None = None,
    least: int = 3,
    epochs: int = 8,
    batches: int = 16,
    rate: float = 0.05,
    l2: float = 1e-5,
    outside: int | None = None,
    seed: int = 0,
) -> Model:
    """Maximum likelihood by Adam over shuffled batches of sequences.

    features: names per form; slots: [slot, token] form numbers; gold: label per token.
    Features seen on fewer than ``least`` tokens are left out, so unseen words are met in
    training as well. With ``outside``, that label stands before and after each sequence;
    else start and end scores are learned.
    """
    k, n_slots = len(labels), len(slots)
    use = np.bincount(slots[0], minlength=len(features))
    count: dict[str, int] = {}
    for fs, c in zip(features, use):
        for f in fs:
            count[f] = count.get(f, 0) + int(c)
    names = {f: i for i, f in enumerate(f for f, c in count.items() if c >= least)}
    width = max(len(fs) for fs in features)
    ids = np.full((len(features), width), len(names), np.int64)  # the last row of the weights stays zero
    for i, fs in enumerate(features):
        known = [names[f] for f in fs if f in names]
        ids[i, : len(known)] = known
    w = np.zeros((len(names) + 1, n_slots * k), np.float32)  # a row per feature, so that rows are fetched and summed as they lie
    chain = np.zeros((k + 2, k), np.float32)  # transitions, then start, then end
    closed = np.zeros((k, k), bool)
    if forbidden:
        closed = np.array([[forbidden(a, b) for b in labels] for a in labels])
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, chain)]
    rng, step = np.random.default_rng(seed), 0

    def parts():
        trans = np.where(closed, FORBIDDEN, chain[:k])
        return (trans, trans[outside], trans[:, outside]) if outside is not None else (trans, chain[k], chain[k + 1])

    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(starts)), min(batches, len(starts))):
            token = np.concatenate([np.arange(starts[s], starts[s] + lengths[s]) for s in part])
            begin = np.r_[0, np.cumsum(lengths[part])[:-1]]
            form = slots[:, token]
            used, form = np.unique(form, return_inverse=True)
            form = form.reshape(n_slots, -1)
            table = w[ids[used]].sum(axis=1).reshape(-1, n_slots, k)
            e = sum(table[form[s], s] for s in range(n_slots))
            trans, first, last = parts()
            diff = np.zeros((len(token), k), np.float32)
            dchain = np.zeros_like(chain)
            y = gold[token]
            for b in padded(lengths[part]):
                cells, index = lay_out(e, begin[b], lengths[part][b])
                post, pairs, _ = forward_backward(cells, lengths[part][b], trans, first, last)
                inside = np.arange(len(cells))[:, None] < lengths[part][b][None, :]
                diff[index[inside]] = post[inside]
                dchain[:k] += pairs
                if outside is None:
                    dchain[k] += post[0].sum(axis=0)
                    dchain[k + 1] += post[lengths[part][b] - 1, np.arange(len(b))].sum(axis=0)
                else:
                    dchain[outside] += post[0].sum(axis=0)
                    dchain[:k, outside] += post[lengths[part][b] - 1, np.arange(len(b))].sum(axis=0)
            diff[np.arange(len(y)), y] -= 1
            heads = begin
            inner = np.ones(len(y), bool)
            inner[heads] = False
            np.add.at(dchain, (y[:-1][inner[1:]], y[1:][inner[1:]]), -1)
            tails = begin + lengths[part] - 1
            if outside is None:
                np.add.at(dchain, (np.full(len(heads), k), y[heads]), -1)
                np.add.at(dchain, (np.full(len(tails), k + 1), y[tails]), -1)
            else:
                np.add.at(dchain, (np.full(len(heads), outside), y[heads]), -1)
                np.add.at(dchain, (y[tails], np.full(len(tails), outside)), -1)
            cell = [(form[s] * k)[:, None] + np.arange(k) for s in range(n_slots)]
            per_form = np.stack([np.bincount(c.ravel(), diff.ravel(), len(used) * k).reshape(-1, k) for c in cell], axis=1).reshape(len(used), -1).astype(np.float32)
            flat = ids[used].ravel()
            order = np.argsort(flat, kind="stable")
            heads_of = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
            dw = np.zeros_like(w)
            dw[flat[order[heads_of]]] = np.add.reduceat(per_form[order // width], heads_of, axis=0)
            step += 1
            for x, g, (m, v) in zip((w, chain), (dw / len(y), dchain / len(y)), state):
                g = g + l2 * x
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w[-1] = 0
    trans, first, last = parts()
    return Model(labels, names, np.ascontiguousarray(w[:-1].reshape(-1, n_slots, k).transpose(1, 0, 2)), trans, first, last)
