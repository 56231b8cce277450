"""A bidirectional gated recurrent network over bytes, in numpy.

Each direction reads the bytes of a window, and both states of a position give
the logits of its label. Training runs backpropagation through time over whole
windows. Reading cuts longer texts into windows, each with some bytes before
and after for the states to settle; padding keeps a state as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PAD = 256
#: Labelled positions of a window when reading, and bytes around them.
WINDOW, CONTEXT = 256, 16
#: Windows read at once.
AT_ONCE = 2048
_OPEN = 40.0


@dataclass
class Network:
    """Weights of two directions; gates in the order update, reset, candidate."""

    inputs: list[np.ndarray]  # (257, 3 h) each
    states: list[np.ndarray]  # (h, 3 h) each
    output: np.ndarray  # (2 h, classes)
    bias: np.ndarray

    @property
    def hidden(self) -> int:
        return self.states[0].shape[0]

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.states, self.output, self.bias]


def new_network(hidden: int, classes: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    net = Network(
        [draw(PAD + 1, 3 * hidden) for _ in range(2)], [draw(hidden, 3 * hidden) for _ in range(2)],
        draw(2 * hidden, classes), np.zeros(classes, np.float32),
    )
    hold_at_padding(net)
    return net


def hold_at_padding(net: Network) -> None:
    """A padded step leaves the state alone: its update gate is one."""
    for w in net.inputs:
        w[PAD] = 0.0
        w[PAD, : net.hidden] = _OPEN


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _step(inputs: np.ndarray, states: np.ndarray, symbols: np.ndarray, h: np.ndarray):
    """Gates (update and reset), candidate and its state part, and the next state."""
    hidden = h.shape[1]
    given, held = inputs.take(symbols, axis=0), h @ states
    gates = given[:, : 2 * hidden] + held[:, : 2 * hidden]
    _sigmoid(gates)
    candidate = gates[:, hidden:] * held[:, 2 * hidden :]
    candidate += given[:, 2 * hidden :]
    np.tanh(candidate, out=candidate)
    new = h - candidate
    new *= gates[:, :hidden]
    new += candidate
    return gates, candidate, held[:, 2 * hidden :], new


def _forward(net: Network, way: int, symbols: np.ndarray) -> list[tuple]:
    h = np.zeros((symbols.shape[1], net.hidden), np.float32)
    trace = []
    for step in symbols:
        gates, candidate, held, new = _step(net.inputs[way], net.states[way], step, h)
        trace.append((step, h, gates, candidate, held))
        h = new
    trace.append((None, h, None, None, None))
    return trace


def _backward(net: Network, way: int, trace: list[tuple], d_states: np.ndarray, grads: list[np.ndarray]) -> None:
    """Adds the gradients of one direction; d_states: loss by the state after each step."""
    hidden = net.hidden
    carried = np.zeros_like(d_states[0])
    for t in range(len(trace) - 2, -1, -1):
        step, h, gates, candidate, held = trace[t]
        z, r = gates[:, :hidden], gates[:, hidden:]
        d_new = d_states[t] + carried
        d_candidate = d_new * (1 - z) * (1 - candidate * candidate)
        d_gates = np.concatenate(
            (d_new * (h - candidate) * z * (1 - z), d_candidate * held * r * (1 - r)), axis=1
        )
        d_given = np.concatenate((d_gates, d_candidate), axis=1)
        d_held = np.concatenate((d_gates, d_candidate * r), axis=1)
        np.add.at(grads[way], step, d_given)
        grads[2 + way] += h.T @ d_held
        carried = d_new * z + d_held @ net.states[way].T


def train(
    windows: np.ndarray, labels: np.ndarray, classes: int, hidden: int, steps: int, batch: int = 96,
    rate: float = 0.02, seed: int = 7,
) -> Network:
    """Learns the label of every position from windows (n, length) of symbols, by Adam."""
    net, rng = new_network(hidden, classes, seed), np.random.default_rng(seed)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    for at in range(1, steps + 1):
        chosen = rng.integers(0, len(windows), batch)
        symbols, wanted = windows[chosen].T, labels[chosen]
        real = (symbols != PAD).astype(np.float32)[..., None]
        traces = [_forward(net, 0, symbols), _forward(net, 1, symbols[::-1])]
        ahead = np.stack([x[1] for x in traces[0][1:]])
        back = np.stack([x[1] for x in traces[1][1:]])[::-1]
        both = np.concatenate((ahead, back), axis=2)
        chances = _softmax(both @ net.output + net.bias)
        chances[:, np.arange(batch), wanted] -= 1.0
        chances *= real / max(1.0, real.sum())
        grads = [np.zeros_like(w) for w in net.weights()]
        grads[4] += np.einsum("tbh,tbc->hc", both, chances)
        grads[5] += chances.sum(axis=(0, 1))
        d_both = chances @ net.output.T
        _backward(net, 0, traces[0], d_both[..., :hidden], grads)
        _backward(net, 1, traces[1], d_both[::-1, :, hidden:], grads)
        scale = min(1.0, 1.0 / (1e-8 + float(np.sqrt(sum((g * g).sum() for g in grads)))))
        pace = rate * min(1.0, at / 20) * (0.1 + 0.9 * (1 - at / steps))
        for w, g, (first, second) in zip(net.weights(), grads, moments):
            g = g * scale
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            w -= pace * (first / (1 - 0.9**at)) / (np.sqrt(second / (1 - 0.99**at)) + 1e-6)
        hold_at_padding(net)
    return net


def _softmax(logits: np.ndarray) -> np.ndarray:
    """In place, as the logits of a block of windows are its largest array."""
    logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-1, keepdims=True)
    return logits


def cut(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts that lie one after another: text number, start, end."""
    sizes = np.array(sizes, np.int64)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    first = np.cumsum(counts) - counts
    place = np.arange(len(text)) - first[text]
    begin = (np.cumsum(sizes) - sizes)[text]
    start = begin + place * WINDOW
    return text, start, np.minimum(start + WINDOW, begin + sizes[text])


def position_sums(net: Network, texts: list[bytes], counted: np.ndarray) -> np.ndarray:
    """Per text, the sums of its positions' label probabilities.

    ``counted``: for each byte value, whether its positions take part.
    """
    classes = len(net.bias)
    sums = np.zeros((len(texts), classes))
    joined = np.frombuffer(b"".join(texts), np.uint8)
    sizes = [len(t) for t in texts]
    text, start, end = cut(sizes)
    begin = np.cumsum(sizes) - sizes
    span = np.arange(-CONTEXT, WINDOW + CONTEXT)
    for a in range(0, len(text), AT_ONCE):
        own, s, e = text[a : a + AT_ONCE], start[a : a + AT_ONCE], end[a : a + AT_ONCE]
        places = s[:, None] + span[None, :]
        inside = (places >= begin[own][:, None]) & (places < (begin[own] + np.array(sizes)[own])[:, None])
        symbols = np.where(inside, joined[np.clip(places, 0, len(joined) - 1)], PAD).astype(np.int64)
        symbols = np.ascontiguousarray(symbols.T)
        del places, inside
        logits = np.zeros((WINDOW, len(own), classes), np.float32)
        hidden = net.hidden
        for way, steps in ((0, range(WINDOW + CONTEXT)), (1, range(WINDOW + 2 * CONTEXT - 1, CONTEXT - 1, -1))):
            h = np.zeros((len(own), hidden), np.float32)
            weights = net.output[way * hidden : (way + 1) * hidden]
            for t in steps:
                h = _step(net.inputs[way], net.states[way], symbols[t], h)[3]
                if CONTEXT <= t < WINDOW + CONTEXT:
                    logits[t - CONTEXT] += h @ weights
        logits += net.bias
        chances = _softmax(logits)
        named = symbols[CONTEXT : CONTEXT + WINDOW]
        use = np.append(counted, False)[named] & (np.arange(WINDOW)[:, None] < (e - s)[None, :])
        chances *= use[..., None]
        np.add.at(sums, own, chances.sum(axis=0))
    return sums
