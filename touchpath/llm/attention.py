"""A small causal self-attention model in numpy: forward, backward, local training, scores of token sequences.

A token's class is predicted in two steps, its group and its place in the group, each by a softmax over what attention
makes of the tokens before it, on top of the logarithms of counted pairs. What precedes a token is seen through a window
of ``context`` + ``stride`` places. Windows overlap by ``context``, and only the last ``stride`` places of a window are scored,
so every token is scored once and, but for the start of a text, with at least ``context`` tokens before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

Params = dict[str, np.ndarray]


@dataclass(frozen=True)
class AttentionOptions:
    """Sizes of the model and of its training. One window in ``every`` of each training text is trained on, once; by default all."""

    groups: int = 32
    members: int = 32
    single: int = 960  # tokens with a class of their own
    width: int = 16
    hidden: int = 16
    context: int = 8
    stride: int = 32
    every: int = 1
    rounds: int = 4
    batch: int = 128
    rate: float = 1.2e-2
    scored_windows: int = 256

    @property
    def places(self) -> int:
        return self.context + self.stride

    @property
    def classes(self) -> int:
        return self.groups * self.members


OPTIONS = AttentionOptions()


@dataclass(frozen=True)
class Pairs:
    """Logarithms of counted pairs: of a group, and of a member within its group, after each class (or none, the last)."""

    group: np.ndarray
    member: np.ndarray


def pair_logits(counts: np.ndarray, options: AttentionOptions = OPTIONS) -> Pairs:
    """From ``counts`` of (class before, class), backed off to the classes' shares."""
    pairs = counts.reshape(options.classes, options.classes).astype(np.float32)
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + options.classes)
    p = (pairs + 4 * share) / (pairs.sum(axis=1, keepdims=True) + 4)
    p = np.vstack((p, share)).reshape(-1, options.groups, options.members)
    total = p.sum(axis=2, keepdims=True)
    return Pairs(np.log(total[..., 0]).astype(np.float32), np.log(p / total).astype(np.float32))


def initial(options: AttentionOptions = OPTIONS) -> Params:
    """The start of training, the same in every run; the output weights are 0, so the model starts as its counted pairs."""
    rng = np.random.default_rng(0)
    d, h = options.width, options.hidden
    shapes = {
        "embed": (options.classes + 1, d), "place": (options.places, d), "query": (d, d), "key": (d, d), "value": (d, d),
        "mix": (d, d), "up": (d, h), "shift": (h,), "down": (h, d), "group": (d, options.groups), "member": (options.groups, d, options.members),
    }
    scale = {"embed": 0.3, "place": 0.1, "shift": 0.0, "group": 0.0, "member": 0.0}
    return {k: (rng.normal(size=s) * scale.get(k, s[0] ** -0.5)).astype(np.float32) for k, s in shapes.items()}


def flat(params: Params) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def views(values: np.ndarray, like: Params) -> Params:
    """Parameters shaped as in ``like`` that lie in ``values`` one after the other, as ``flat`` puts them."""
    params, at = {}, 0
    for k in sorted(like):
        params[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return params


def shaped(values: np.ndarray, like: Params) -> Params:
    return views(values.astype(np.float32), like)


def window_counts(ends: np.ndarray, options: AttentionOptions = OPTIONS) -> np.ndarray:
    """Windows of each text."""
    return -(-np.diff(ends, prepend=0) // options.stride)


def windows(classes: np.ndarray, ends: np.ndarray, options: AttentionOptions = OPTIONS, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over concatenated texts: inputs, places of the scored tokens, and the text of each window.

    ``classes`` holds the classes of all texts, each closed by the end token's; ``ends`` where each text ends; ``chosen`` the
    numbers of the wanted windows. The input of a place is the class before it, at the start of a text the end token's.
    Places without a token are -1, their input is the extra class ``options.classes``.
    """
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    counts = window_counts(ends, options)
    text = np.repeat(np.arange(len(ends)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    if chosen is not None:
        text, number = text[chosen], number[chosen]
    first = starts[text] + number * options.stride
    at = first[:, None] + np.arange(-options.context, options.stride)
    inside = (at >= starts[text][:, None]) & (at < ends[text][:, None])
    before = np.concatenate((classes[-1:], classes[:-1]))  # the class before a text's start is the end token's
    inputs = np.where(inside, before[np.where(inside, at, 0)], options.classes).astype(np.int16, copy=False)
    scored = np.where(inside, at, -1)[:, options.context :]
    return inputs, scored, text


@lru_cache(maxsize=8)
def _causal(options: AttentionOptions) -> np.ndarray:
    """What is added to the weight of a place (column) for a scored place (row)."""
    place = np.arange(-options.context, options.stride)
    return np.where(place <= place[options.context :, None], 0, -1e9).astype(np.float32)


@lru_cache(maxsize=8)
def _cells(options: AttentionOptions) -> np.ndarray:
    """Where the components of each class's embedding lie in one dimension."""
    return np.arange((options.classes + 1) * options.width).reshape(-1, options.width)


def _exponentials(x: np.ndarray, most: float) -> np.ndarray:
    """exp of ``x``, in place, scaled by rows where a value of up to ``most`` could overflow."""
    if most > 60:
        x -= x.max(axis=-1, keepdims=True)
    return np.exp(x, out=x)


def _longest(x: np.ndarray) -> float:
    flat_x = x.reshape(-1, x.shape[-1])
    return float(np.sqrt(np.einsum("ij,ij->i", flat_x, flat_x).max(initial=0)))


def _largest(x: np.ndarray) -> float:
    return max(float(x.max(initial=0)), -float(x.min(initial=0)))


def _most(q: np.ndarray, k: np.ndarray) -> float:
    """What no product of a row of ``q`` and one of ``k`` exceeds; lengths of rows are only taken where components do not tell."""
    most = _largest(q) * _largest(k) * q.shape[-1]
    return most if most <= 60 else _longest(q) * _longest(k)


def _times(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One product over all windows."""
    return (left.reshape(-1, left.shape[-1]) @ right).reshape(*left.shape[:-1], right.shape[1])


def _attended(params: Params, inputs: np.ndarray, options: AttentionOptions) -> tuple:
    """What the scored places see: every step from the embedded inputs to the hidden state, the last of the tuple."""
    c, d, n = options.context, options.width, len(inputs)
    x = params["embed"].take(inputs, axis=0)
    x += params["place"]
    asked = np.ascontiguousarray(x[:, c:])
    q = _times(asked, params["query"] * np.float32(d**-0.5))
    both = _times(x, np.concatenate((params["key"], params["value"]), axis=1))
    k, v = both[..., :d], both[..., d:]
    s = q @ k.transpose(0, 2, 1)
    s += _causal(options)
    first = np.flatnonzero(inputs[:, 0] == options.classes)  # windows with places before the text's start
    s[first] += np.where(inputs[first] == options.classes, np.float32(-1e9), np.float32(0))[:, None, :]
    a = _exponentials(s, _most(q, k))
    seen = a @ np.concatenate((v, np.ones((n, options.places, 1), v.dtype)), axis=2)  # the weights' total comes along
    total = np.maximum(seen[..., d:], np.float32(1e-30))
    z = seen[..., :d] / total
    h = _times(z, params["mix"])
    h += asked
    r = _times(h, params["up"])
    r += params["shift"]
    np.maximum(r, 0, out=r)
    y = _times(r, params["down"])
    y += h
    return x, asked, q, both, a, total, z, h, r, y


def _by_group(targets: np.ndarray, options: AttentionOptions) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Order of the targets by group, their groups, and (group, from, to) of each group that occurs."""
    groups = targets // options.members
    order = np.argsort(groups.astype(np.uint8 if options.groups <= 256 else np.int64), kind="stable")
    ends = np.cumsum(np.bincount(groups, minlength=options.groups)).tolist()
    return order, groups, [(g, lo, hi) for g, (lo, hi) in enumerate(zip([0, *ends], ends, strict=False)) if hi > lo]


def _chances(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of column ``at`` of each row; in place of ``logits`` its exponentials, and their totals."""
    most = float(logits.max(initial=0))
    if most > 60:
        logits -= logits.max(axis=-1, keepdims=True)
    own = logits[np.arange(len(at)), at]
    p = np.exp(logits, out=logits)
    total = p @ np.ones((p.shape[1], 1), p.dtype)
    return own - np.log(total[:, 0]), p, total


def _predicted(params: Params, pairs: Pairs, y: np.ndarray, inputs: np.ndarray, places: np.ndarray, targets: np.ndarray, options: AttentionOptions) -> tuple:
    """Log probabilities of ``targets`` at ``places`` of the windows' scored ones, in order of groups: with them the order, of
    each target in it the place, the row of ``y``, group and member, the groups' parts, and of both steps exponentials and totals."""
    order, groups, parts = _by_group(targets, options)
    places, groups = places[order], groups[order]
    members = targets[order] - groups * options.members
    y = y.reshape(-1, options.width).take(places, axis=0)
    before = np.ascontiguousarray(inputs[:, options.context :]).reshape(-1).take(places).astype(np.intp)
    in_group = pairs.member.reshape(-1, options.members).take(before * options.groups + groups, axis=0)
    for g, lo, hi in parts:
        in_group[lo:hi] += y[lo:hi] @ params["member"][g]
    logits = y @ params["group"]
    logits += pairs.group.take(before, axis=0)
    logp, *p_group = _chances(logits, groups)
    more, *p_member = _chances(in_group, members)
    return logp + more, (order, places, y, groups, members), parts, p_group, p_member


def gradient(params: Params, pairs: Pairs, inputs: np.ndarray, targets: np.ndarray, options: AttentionOptions = OPTIONS) -> tuple[float, Params]:
    """Mean loss over the scored places (``targets`` >= 0) and its gradient."""
    c = options.context
    x, asked, q, both, a, total, z, h, r, y = _attended(params, inputs, options)
    k, v = both[..., : options.width], both[..., options.width :]
    a /= total
    at = np.flatnonzero(targets >= 0)
    logp, (_, at, flat_y, groups, members), parts, *steps = _predicted(params, pairs, y, inputs, at, targets.reshape(-1).take(at).astype(np.int64), options)
    n, rows = np.float32(max(1, len(at))), np.arange(len(at))
    for (p, sums), own in zip(steps, (groups, members), strict=True):
        p /= sums
        p.reshape(-1)[rows * p.shape[1] + own] -= 1
        p /= n
    dg, dm = (p for p, _ in steps)
    g = {"group": flat_y.T @ dg, "member": np.zeros_like(params["member"])}
    dflat = dg @ params["group"].T
    for group, lo, hi in parts:
        g["member"][group] = flat_y[lo:hi].T @ dm[lo:hi]
        dflat[lo:hi] += dm[lo:hi] @ params["member"][group].T
    dy = np.zeros_like(y)
    dy.reshape(-1, options.width)[at] = dflat

    def over(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.reshape(-1, left.shape[-1]).T @ right.reshape(-1, right.shape[-1])

    scale = np.float32(options.width**-0.5)
    g["down"] = over(r, dy)
    dr = _times(dy, params["down"].T)
    dr *= r > 0
    g["up"], g["shift"] = over(h, dr), dr.sum(axis=(0, 1))
    dh = _times(dr, params["up"].T)
    dh += dy
    g["mix"] = over(z, dh)
    dz = _times(dh, params["mix"].T)
    ds = dz @ v.transpose(0, 2, 1)
    back = np.empty_like(both)  # of keys and values, beside each other
    dk, dv = back[..., : options.width], back[..., options.width :]
    np.matmul(a.transpose(0, 2, 1), dz, out=dv)
    ds -= (dz * z).sum(axis=-1, keepdims=True)  # what the weights' sum of 1 takes back
    ds *= a
    np.matmul(ds.transpose(0, 2, 1), q, out=dk)
    dq = ds @ k
    dq *= scale
    g["query"] = over(asked, dq)
    g["key"], g["value"] = np.split(over(x, back), 2, axis=1)
    dx = _times(dk, params["key"].T)
    dx += _times(dv, params["value"].T)
    dh += _times(dq, params["query"].T)
    dx[:, c:] += dh
    g["place"] = dx.sum(axis=0)
    g["embed"] = np.zeros_like(params["embed"])
    cells = _cells(options).take(inputs.reshape(-1), axis=0)
    np.add.at(g["embed"].reshape(-1), cells.ravel(), dx.reshape(-1))  # in one dimension many times faster
    return -float(logp.sum()) / float(n), g


def train_locally(params: Params, pairs: Pairs, batches: Iterator[tuple[np.ndarray, np.ndarray]], rate: float, options: AttentionOptions = OPTIONS) -> tuple[Params, int]:
    """Adam over ``batches`` of (inputs, targets) from ``params`` on; the new parameters and the windows seen."""
    values = flat(params)
    params = views(values, params)
    mean, square = np.zeros_like(values), np.zeros_like(values)
    seen = step = 0
    for inputs, targets in batches:
        _, g = gradient(params, pairs, inputs, targets, options)
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        step += 1
        x = flat(g) * min(1.0, 1.0 / max(size, 1e-9))
        mean += 0.1 * (x - mean)
        square += 0.01 * (x * x - square)
        values -= np.float32(rate) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        seen += len(inputs)
    return params, seen


def class_scores(params: Params, pairs: Pairs, classes: np.ndarray, ends: np.ndarray, options: AttentionOptions = OPTIONS) -> np.ndarray:
    """Natural log probability of every token's class, each from the one window that scores it."""
    out = np.zeros(len(classes))
    inputs, scored, _ = windows(classes, ends, options)
    for at in range(0, len(inputs), options.scored_windows):
        part, seen = scored[at : at + options.scored_windows], inputs[at : at + options.scored_windows]
        at_once = np.flatnonzero(part >= 0)
        place = part.reshape(-1).take(at_once)
        y = _attended(params, seen, options)[-1]
        logp, (order, *_), *_ = _predicted(params, pairs, y, seen, at_once, classes[place], options)
        out[place[order]] = logp
    return out
