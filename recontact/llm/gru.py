"""A gated recurrent language model with class-factored output, in numpy.

Vocabulary ids 0..n-1 are frequent words, the ids behind them stand for groups of all other words. The output is factored:
P(id | state) = P(class | state) * P(id | class, state). A group is a class of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Steps through which gradients flow back; the state itself is carried on.
STEPS = 16
HIDDEN = 16
RATE = 0.1
CLIP = 5.0
#: Training cuts longer documents into streams of this many tokens, to fill its lanes evenly.
STREAM = 512


def classes_of(counts: np.ndarray, groups: int, bins: int) -> np.ndarray:
    """Class of every id: frequent words (in falling order of counts) in bins of about equal mass, then one class per group."""
    n = len(counts) - groups
    mass = np.cumsum(counts[:n] + 1.0)
    binned = np.minimum((mass - counts[:n] - 1.0) * bins / (mass[-1] if n else 1.0), bins - 1).astype(np.int64)
    _, dense = np.unique(binned, return_inverse=True)
    first = dense.max(initial=-1) + 1
    return np.concatenate([dense, first + np.arange(groups)]).astype(np.int64)


def _softmax(logits: np.ndarray, rows: np.ndarray, own: np.ndarray, whole: bool) -> np.ndarray:
    """Log probability of one column per row; with ``whole`` the logits become probabilities in place."""
    logits -= logits.max(axis=1, keepdims=True)
    picked = logits[rows, own]
    np.exp(logits, out=logits)
    total = logits.sum(axis=1)
    if whole:
        logits /= total[:, None]
    return picked - np.log(total)


@dataclass
class Network:
    """Parameters (float32) by name and the class of every id; ids of a class are neighbours."""

    of_class: np.ndarray
    values: dict[str, np.ndarray]

    @classmethod
    def new(cls, counts: np.ndarray, groups: int, bins: int, hidden: int = HIDDEN, seed: int = 1) -> Network:
        """Starts as the unigram model: output biases are log frequencies, output weights zero."""
        draw = np.random.default_rng(seed)
        of_class = classes_of(counts, groups, bins)
        mass = np.bincount(of_class, weights=counts + 1.0)
        values = {
            "x": draw.normal(0, 0.3, (len(counts), 3 * hidden)), "u": draw.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden)),
            "b": np.concatenate([np.full(hidden, 1.0), np.zeros(2 * hidden)]), "cw": np.zeros((hidden, len(mass))), "cb": np.log(mass / mass.sum()),
            "ww": np.zeros((hidden, len(counts))), "wb": np.log((counts + 1.0) / mass[of_class])}
        return cls(of_class, {k: v.astype(np.float32) for k, v in values.items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([self.values[k].ravel() for k in sorted(self.values)])

    def with_flat(self, flat: np.ndarray) -> Network:
        values, at = {}, 0
        for k in sorted(self.values):
            old = self.values[k]
            values[k] = np.asarray(flat[at:at + old.size], np.float32).reshape(old.shape).copy()
            at += old.size
        return Network(self.of_class, values)

    def _step(self, ids: np.ndarray, h: np.ndarray):
        p, k = self.values, h.shape[1]
        gates = p["xb"][ids] if "xb" in p else p["x"][ids] + p["b"]
        zr = 1 / (1 + np.exp(-(gates[:, :2 * k] + h @ p["u"][:, :2 * k])))
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(gates[:, 2 * k:] + (r * h) @ p["u"][:, 2 * k:])
        return z, r, n, n + z * (h - n)

    def _output(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None):
        """Natural log probability of every target; with ``grads`` also the states' gradient of the summed loss."""
        p = self.values
        logits = states @ p["cw"] + p["cb"]
        # A byte per class sorts faster.
        cls = self.of_class.astype(np.uint8 if self.of_class.max(initial=0) < 256 else np.int64)[targets]
        rows = np.arange(len(targets))
        out = _softmax(logits, rows, cls, grads is not None)
        back = None
        if grads is not None:
            logits[rows, cls] -= 1
            grads["cw"] += states.T @ logits
            grads["cb"] += logits.sum(axis=0)
            back = logits @ p["cw"].T
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(self.of_class[-1] + 2)) if len(self.of_class) else []
        firsts = np.searchsorted(self.of_class, np.arange(self.of_class[-1] + 2))
        for c in range(len(bounds) - 1):
            lo, hi = firsts[c], firsts[c + 1]
            # A class of one id has probability one inside.
            if bounds[c] == bounds[c + 1] or hi - lo == 1:
                continue
            at = order[bounds[c]:bounds[c + 1]]
            inner = states[at] @ p["ww"][:, lo:hi] + p["wb"][lo:hi]
            own, places = targets[at] - lo, rows[:len(at)]
            out[at] += _softmax(inner, places, own, grads is not None)
            if grads is not None:
                inner[places, own] -= 1
                grads["ww"][:, lo:hi] += states[at].T @ inner
                grads["wb"][lo:hi] += inner.sum(axis=0)
                back[at] += inner @ p["ww"][:, lo:hi].T
        return out, back


def lanes_of(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Streams dealt to lanes, the longest first to the shortest lane; at most ``most`` lanes, and no lane much longer
    than the longest stream, so the padded area stays near the number of tokens."""
    import heapq
    count = int(min(most, max(1, -(-int(lengths.sum()) // max(1, int(lengths.max(initial=1)))))))
    heap = [(0, k) for k in range(count)]
    lanes: list[list[int]] = [[] for _ in range(count)]
    for i in np.argsort(-lengths, kind="stable"):
        size, k = heapq.heappop(heap)
        lanes[k].append(int(i))
        heapq.heappush(heap, (size + int(lengths[i]), k))
    sizes = [int(lengths[lane].sum()) for lane in lanes]
    return [lanes[k] for k in np.argsort([-s for s in sizes], kind="stable") if lanes[k]]


def laid_out(streams: list[np.ndarray], lanes: list[list[int]], start: int):
    """inputs, targets, fresh (a stream begins), as lane x time; lane lengths; place of every stream."""
    sizes = np.array([sum(len(streams[i]) for i in lane) for lane in lanes])
    longest = int(sizes.max(initial=0))
    targets = np.zeros((len(lanes), longest), np.int32)
    fresh = np.zeros((len(lanes), longest), bool)
    places: dict[int, tuple[int, int]] = {}
    for k, lane in enumerate(lanes):
        at = 0
        for i in lane:
            targets[k, at:at + len(streams[i])] = streams[i]
            fresh[k, at] = True
            places[i] = (k, at)
            at += len(streams[i])
    inputs = np.empty_like(targets)
    inputs[:, 1:] = targets[:, :-1]
    inputs[fresh] = start
    if longest:
        inputs[:, 0] = start
    return inputs, targets, fresh, sizes, places


def scores(net: Network, streams: list[np.ndarray], start: int, most: int = 512, steps: int = 32) -> np.ndarray:
    """Natural log likelihood of every whole stream: the state runs through all of its windows."""
    # Nothing changes here, so the input rows hold the gates' biases.
    net = Network(net.of_class, net.values | {"xb": net.values["x"] + net.values["b"]})
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    out = np.zeros(len(streams))
    if not lengths.sum():
        return out
    inputs, targets, fresh, sizes, places = laid_out(streams, lanes_of(lengths, most), start)
    total = np.zeros(targets.shape, np.float32)
    h = np.zeros((len(sizes), net.values["u"].shape[0]), np.float32)
    for at in range(0, targets.shape[1], steps):
        n = int(np.searchsorted(-sizes, -at, side="left"))  # lanes that still have tokens
        h, window = h[:n], []
        upto = min(at + steps, targets.shape[1])
        for t in range(at, upto):
            if fresh[:n, t].any():
                h = np.where(fresh[:n, t, None], np.float32(0), h)
            *_, h = net._step(inputs[:n, t], h)
            window.append(h)
        found, _ = net._output(np.concatenate(window), targets[:n, at:upto].T.ravel())
        total[:n, at:upto] = found.reshape(upto - at, n).T
    for i, (k, at) in places.items():
        out[i] = total[k, at:at + len(streams[i])].sum(dtype=np.float64)
    return out


def train(net: Network, streams: list[np.ndarray], start: int, most: int = 256, rate: float = RATE) -> Network:
    """One pass of Adagrad over the streams by truncated backpropagation through ``STEPS`` steps."""
    net = net.with_flat(net.flat())
    pieces = [s[a:a + STREAM] for s in streams for a in range(0, len(s), STREAM)]
    lengths = np.array([len(s) for s in pieces], dtype=np.int64)
    tokens = int(lengths.sum())
    if not tokens:
        return net
    # Enough updates also for few tokens: about 64 windows or more a pass.
    lanes = lanes_of(lengths, int(min(most, max(8, tokens // (64 * STEPS)))))
    inputs, targets, fresh, sizes, _ = laid_out(pieces, lanes, start)
    p, k = net.values, net.values["u"].shape[0]
    seen = {name: np.full(v.shape, 1e-2, np.float32) for name, v in p.items()}
    h = np.zeros((len(sizes), k), np.float32)
    for at in range(0, targets.shape[1], STEPS):
        n = int(np.searchsorted(-sizes, -at, side="left"))
        h, upto, saved = h[:n], min(at + STEPS, targets.shape[1]), []
        for t in range(at, upto):
            before = np.where(fresh[:n, t, None], np.float32(0), h)
            z, r, cand, h = net._step(inputs[:n, t], before)
            saved.append((before, z, r, cand, h))
        real = np.arange(at, upto)[:, None] < sizes[None, :n]
        grads = {name: np.zeros_like(v) for name, v in p.items() if name != "x"}
        states, wanted = np.concatenate([s[4] for s in saved]), targets[:n, at:upto].T.ravel()
        if real.all():
            flat = wanted
            _, all_back = net._output(states, wanted, grads)
        else:
            flat = np.flatnonzero(real.ravel())
            _, back = net._output(states[flat], wanted[flat], grads)
            all_back = np.zeros_like(states)
            all_back[flat] = back
        all_back = all_back.reshape(upto - at, n, k)
        gates = np.zeros((upto - at, n, 3 * k), np.float32)
        carried = np.zeros((n, k), np.float32)
        un, uzr = p["u"][:, 2 * k:], p["u"][:, :2 * k]
        for t in range(upto - at - 1, -1, -1):
            before, z, r, cand, _ = saved[t]
            g = all_back[t] + carried
            gn = g * (1 - z) * (1 - cand * cand)
            gz = g * (before - cand) * z * (1 - z)
            gated = gn @ un.T
            gr = gated * before * r * (1 - r)
            gates[t, :, :k], gates[t, :, k:2 * k], gates[t, :, 2 * k:] = gz, gr, gn
            carried = g * z + gated * r + gates[t, :, :2 * k] @ uzr.T
            carried[fresh[:n, at + t]] = 0
        flat_gates = gates.reshape(-1, 3 * k)
        states_before = np.concatenate([s[0] for s in saved])
        grads["u"][:, :2 * k] += states_before.T @ flat_gates[:, :2 * k]
        grads["u"][:, 2 * k:] += (np.concatenate([s[2] for s in saved]) * states_before).T @ flat_gates[:, 2 * k:]
        grads["b"] += flat_gates.sum(axis=0)
        ids = inputs[:n, at:upto].T.ravel()
        order = np.argsort(ids, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
        touched, gx = ids[order][heads], np.add.reduceat(flat_gates[order], heads, axis=0)
        scale = np.float32(1 / max(1, len(flat)) ** 0.5)
        for name, g in grads.items():
            g *= scale
            np.clip(g, -CLIP, CLIP, out=g)
            seen[name] += g * g
            p[name] -= np.float32(rate) * g / np.sqrt(seen[name])
        gx = np.clip(gx * scale, -CLIP, CLIP)
        seen["x"][touched] += gx * gx
        p["x"][touched] -= np.float32(rate) * gx / np.sqrt(seen["x"][touched])
    return net
