"""A character-level bidirectional LSTM with CRF transitions, in numpy.

``train`` fits it to labelled windows by gradient descent on the CRF's likelihood;
``decode`` gives the best tag sequence of each window and each character's posterior
of its tag. A model is a plain dict of arrays, so it travels without this module.

Both directions run as one batch: the backward one reads each window from its end.
"""

from __future__ import annotations

import numpy as np

#: characters 32 to 126 have ids of their own; then line ends, other letters, all others, and padding
FIRST, LAST = 32, 126
LINE, LETTER, OTHER, PAD = 95, 96, 97, 98
ALPHABET = 99


def char_ids(text: str) -> np.ndarray:
    """The id of every character of a text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ids = np.where((code >= FIRST) & (code <= LAST), code - FIRST, OTHER).astype(np.int16)
    ids[(code == 10) | (code == 13)] = LINE
    high = np.flatnonzero(code > 127)
    if len(high):
        kinds = {c: LETTER if chr(c).isalpha() else OTHER for c in np.unique(code[high]).tolist()}
        ids[high] = [kinds[c] for c in code[high].tolist()]
    return ids


def start(tags: int, embed: int, hidden: int, seed: int) -> dict:
    """A model before training: embeddings, one LSTM per direction (gates i, f, o, g), output layer, transitions."""
    rng = np.random.default_rng(seed)

    def some(*shape, scale=None):
        return rng.normal(0, scale or 1 / np.sqrt(shape[-2]), shape).astype(np.float32)

    bias = np.zeros((2, 1, 4 * hidden), np.float32)
    bias[:, :, hidden:2 * hidden] = 1  # remember at first
    return {"embed": some(ALPHABET, embed, scale=0.5), "wx": some(2, embed, 4 * hidden), "wh": some(2, hidden, 4 * hidden),
            "b": bias, "out": some(2 * hidden, tags), "out_b": np.zeros(tags, np.float32),
            "move": np.zeros((tags, tags), np.float32), "first": np.zeros(tags, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _forward(m: dict, ids: np.ndarray, keep: bool):
    """Emissions (T, B, tags) for ids (B, T); with ``keep`` all that the way back needs."""
    b, t = ids.shape
    h = m["wh"].shape[1]
    both = np.stack([ids.T, ids.T[::-1]], 0)                       # 2, T, B
    table = m["embed"] @ m["wx"] + m["b"]                           # 2, alphabet, 4h
    state, cell = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
    out = np.empty((t, 2, b, h), np.float32)
    saved = []
    for k in range(t):
        z = np.matmul(state, m["wh"])
        z[0] += table[0, both[0, k]]
        z[1] += table[1, both[1, k]]
        gates = _sigmoid(z[..., :3 * h])
        g = np.tanh(z[..., 3 * h:])
        before = cell
        cell = gates[..., h:2 * h] * cell + gates[..., :h] * g
        tc = np.tanh(cell)
        if keep:
            saved.append((state, before, gates, g, tc))
        state = gates[..., 2 * h:] * tc
        out[k] = state
    hidden = np.concatenate([out[:, 0], out[::-1, 1]], -1)          # T, B, 2h
    emit = hidden @ m["out"] + m["out_b"]
    return emit, hidden, both, saved


def _marginals(m: dict, emit: np.ndarray, lengths: np.ndarray):
    """Log partition (B), posteriors (T, B, tags) and the summed expected moves (tags, tags).

    Forward and backward passes in probabilities, scaled to sum 1 at every step.
    """
    t, b, n = emit.shape
    live = np.arange(t)[:, None] < lengths                           # T, B
    peak = emit.max(2, keepdims=True)
    weight, move = np.exp(emit - peak), np.exp(m["move"])
    alpha, scale = np.empty_like(emit), np.ones((t, b, 1), emit.dtype)
    a = weight[0] * np.exp(m["first"])
    scale[0] = a.sum(1, keepdims=True)
    alpha[0] = a / scale[0]
    for k in range(1, t):
        a = (alpha[k - 1] @ move) * weight[k]
        c = a.sum(1, keepdims=True)
        on = live[k][:, None]
        alpha[k] = np.where(on, a / c, alpha[k - 1])
        scale[k] = np.where(on, c, 1)
    total = (np.log(scale[..., 0]) + peak[..., 0] * live).sum(0)
    beta = np.ones((b, n), emit.dtype)
    post = np.empty_like(emit)
    moves = np.zeros((n, n))
    for k in range(t - 1, -1, -1):
        on = live[k][:, None]
        post[k] = alpha[k] * beta * on
        if k:
            into = weight[k] * beta / scale[k]
            moves += alpha[k - 1].T @ (into * on)
            beta = np.where(on, into @ move.T, beta)
    return total, post, moves * move


def _gradients(m: dict, ids: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[float, dict]:
    emit, hidden, both, saved = _forward(m, ids, True)
    t, b, n = emit.shape
    total, post, moves = _marginals(m, emit, lengths)
    live = np.arange(t)[:, None] < lengths
    gold = tags.T
    rows, cols = np.nonzero(live)
    score = np.zeros(b)
    np.add.at(score, cols, emit[rows, cols, gold[rows, cols]])
    score += m["first"][gold[0]]
    r, c = np.nonzero(live[1:])
    np.add.at(score, c, m["move"][gold[r, c], gold[r + 1, c]])
    d_emit = post
    d_emit[rows, cols, gold[rows, cols]] -= 1
    d_emit = d_emit / b
    true = np.zeros((n, n))
    np.add.at(true, (gold[r, c], gold[r + 1, c]), 1)
    d = {"move": (moves - true) / b, "first": d_emit[0].sum(0), "out_b": d_emit.sum((0, 1)),
         "out": np.tensordot(hidden, d_emit, ((0, 1), (0, 1)))}
    h = m["wh"].shape[1]
    d_hidden = d_emit @ m["out"].T
    d_wh, d_b = np.zeros_like(m["wh"]), np.zeros_like(m["b"])
    steps = np.empty((2, t, b, 4 * h), np.float32)
    d_state, d_cell = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
    for k in range(t - 1, -1, -1):
        state, before, gates, g, tc = saved[k]
        d_state = d_state + np.stack([d_hidden[k, :, :h], d_hidden[t - 1 - k, :, h:]])
        i, f, o = gates[..., :h], gates[..., h:2 * h], gates[..., 2 * h:]
        d_cell = d_cell + d_state * o * (1 - tc * tc)
        dz = np.concatenate([d_cell * g * i * (1 - i), d_cell * before * f * (1 - f), d_state * tc * o * (1 - o),
                             d_cell * i * (1 - g * g)], -1)
        d_wh += np.matmul(state.transpose(0, 2, 1), dz)
        d_b += dz.sum(1, keepdims=True)
        steps[:, k] = dz
        d_state = np.matmul(dz, m["wh"].transpose(0, 2, 1))
        d_cell = d_cell * f
    # sums by character: a product with the one-hot characters
    d_table = np.stack([np.eye(ALPHABET, dtype=np.float32)[both[side].ravel()].T @ steps[side].reshape(t * b, -1)
                        for side in (0, 1)])
    d |= {"wh": d_wh, "b": d_b, "wx": np.matmul(m["embed"].T, d_table),
          "embed": np.matmul(d_table, m["wx"].transpose(0, 2, 1)).sum(0)}
    return float((total - score).mean()), d


def train(windows: list[tuple[str, list[int]]], tags: int, *, embed: int = 16, hidden: int = 16, epochs: int = 12,
          batch: int = 80, rate: float = 0.02, seed: int = 1) -> dict:
    """A model of the given (text, tag of each character) windows; Adam, gradients cut at norm 5."""
    m = start(tags, embed, hidden, seed)
    if not windows:
        return m
    width = max(len(text) for text, _ in windows)
    ids = np.full((len(windows), width), PAD, np.int16)
    gold = np.zeros((len(windows), width), np.int64)
    lengths = np.array([len(text) for text, _ in windows])
    for row, (text, marks) in enumerate(windows):
        ids[row, :len(text)] = char_ids(text)
        gold[row, :len(text)] = marks
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in m.items()}
    second = {k: np.zeros_like(v) for k, v in m.items()}
    step, steps = 0, epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            _, d = _gradients(m, ids[pick], gold[pick], lengths[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in d.values()))
            step += 1
            now = rate * (1 - (step - 1) / steps)
            for k, g in d.items():
                g = (g * min(1.0, 5 / (norm + 1e-9))).astype(np.float32)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                m[k] = m[k] - now * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return m


def decode(m: dict, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags (B, T) of each window, and the posterior of each of them."""
    emit, *_ = _forward(m, ids, False)
    t, b, n = emit.shape
    _, post, _ = _marginals(m, emit, lengths)
    best = emit[0] + m["first"]
    back = np.zeros((t, b, n), np.int8)
    for k in range(1, t):
        way = best[:, :, None] + m["move"]
        back[k] = way.argmax(1)
        on = (k < lengths)[:, None]
        best = np.where(on, way.max(1) + emit[k], best)
        back[k] = np.where(on, back[k], np.arange(n, dtype=np.int8))
    tags = np.empty((b, t), np.int64)
    tags[:, -1] = best.argmax(1)
    for k in range(t - 1, 0, -1):
        tags[:, k - 1] = back[k][np.arange(b), tags[:, k]]
    sure = np.take_along_axis(post.transpose(1, 0, 2), tags[:, :, None], 2)[:, :, 0]
    return tags, sure
