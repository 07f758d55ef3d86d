"""Language-model scoring with a small causal self-attention model in numpy.

The model reads the words of a text and its end. The commonest words of all training texts have vectors of their own;
all others share one, and are told apart by their counts. Windows of 2 * STRIDE positions overlap by half; the later
half of a window is scored, so that every token is scored exactly once with STRIDE to 2 * STRIDE - 1 positions before it
in view. The next token's class comes from masked attention, its place in the class from counts over all training
texts. Classes and first vectors come from the neighbours of ids in all training texts, and the weights learn from
every window of all training texts.

A memory of phrases of all training texts is mixed in: a hash of two neighbouring words says where a phrase ends, so a
text has one way of being cut, and a phrase is either recalled as it stands, with the frequency that the other
training texts give it, or spelled by attention token by token.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, ready, staged
from .words import Words, batch, binary, mix, pieces

STRIDE, WIDTH, HEAD, CLASSES = 16, 24, 8, 96
CHUNK, BLOCK = 256, 512  # windows, and targets of them, at once: class scores stay in the cache
#: Words with a vector of their own; ids of neighbours that tell the classes apart.
OWN, COMMON = 16_384, 64
#: Rounds of learning: shares (of 16) of all training texts, and the step size at their begin and end. Together they hold
#: every text once. A task of a round has at least TASK windows; fewer than EPOCHS windows in all are gone over up to 4 times.
ROUNDS = ((1, 0.01, 0.008), (3, 0.008, 0.005), (12, 0.005, 0.001))
TASK, EPOCHS = 65_536, 131_072
#: One of so many pairs of words ends a phrase; the chance that a phrase is recalled.
PHRASE, RECALL = 16, 0.1
#: Words and phrases are looked up in the shared tables if they are at least this share, of which there are at most
#: LISTED, and beyond that as far down as LISTED rows go.
FREQUENT, LISTED = 1e-6, 1_000_000


def layout(docs: list[np.ndarray], start: int, pad: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One stream of all documents: STRIDE pads, start and ids, padded to STRIDE. Inputs, targets (-1: none) and owner."""
    total = sum(STRIDE + -(-(len(d) + 1) // STRIDE) * STRIDE for d in docs)
    x, y, owner = np.full(total, pad, np.int64), np.full(total, -1, np.int64), np.zeros(total, np.int64)
    at = 0
    for k, d in enumerate(docs):
        n, size = len(d) + 1, -(-(len(d) + 1) // STRIDE) * STRIDE
        owner[at : at + STRIDE + size] = k
        at += STRIDE
        x[at], x[at + 1 : at + n] = start, d
        y[at : at + n - 1], y[at + n - 1] = d, end
        at += size
    return x, y, owner


def view(a: np.ndarray, size: int) -> np.ndarray:
    """Overlapping (windows, size, width) view of a stream, STRIDE apart."""
    n = (len(a) - size) // STRIDE + 1
    return np.lib.stride_tricks.as_strided(a, (n, size, a.shape[1]), (a.strides[0] * STRIDE, *a.strides), writeable=False)


@dataclass
class Attention:
    embed: np.ndarray  # (ids + 2, WIDTH); the last two rows are pad and start
    wq: np.ndarray
    wk: np.ndarray
    wv: np.ndarray
    near: np.ndarray  # (2 * STRIDE,) bias by distance
    wo: np.ndarray
    bias: np.ndarray
    group: np.ndarray  # class of every id
    inside: np.ndarray  # log p(id | class)

    def prepared(self) -> Attention:
        e = self.embed
        self.rows = np.concatenate([e @ self.wk, e @ self.wv, e @ self.wq / np.sqrt(HEAD), e], axis=1).astype(np.float32)
        far = np.arange(STRIDE)[:, None] + STRIDE - np.arange(2 * STRIDE)[None, :]
        self.mask = np.where(far >= 0, self.near[np.clip(far, 0, 2 * STRIDE - 1)], -1e9).astype(np.float32)
        self.out = np.concatenate([self.wo, self.bias[None, :]]).astype(np.float32)
        # norms bound the exponents; only where they could leave float32 the largest one is taken off first
        norm = lambda x: float(np.sqrt((x * x).sum(axis=1)).max())
        k, v, q, x = np.split(self.rows, [HEAD, HEAD + WIDTH, 2 * HEAD + WIDTH], axis=1)
        top = (norm(q) * norm(k) + float(np.abs(self.near).max()), (norm(x) + norm(v)) * norm(self.wo.T) + float(np.abs(self.bias).max()))
        self.steep = [b > 75 for b in top]
        return self

    def log_probs(self, docs: list[np.ndarray], end: int) -> np.ndarray:
        """Natural-log probability of every id and end of the documents, in reading order."""
        if not docs:
            return np.zeros(0)
        x, y, _ = layout(docs, len(self.embed) - 1, len(self.embed) - 2, end)
        parts, ones = [], np.ones(CLASSES, np.float32)
        step = CHUNK * STRIDE
        for a in range(0, len(x) - STRIDE, step):
            b = min(len(x), a + step + STRIDE)
            g = self.rows[x[a:b]]
            k, v = view(g[:, :HEAD], 2 * STRIDE), view(g[:, HEAD : HEAD + WIDTH], 2 * STRIDE)
            n = len(k)
            q = g[STRIDE : STRIDE + n * STRIDE, HEAD + WIDTH : 2 * HEAD + WIDTH].reshape(n, STRIDE, HEAD)
            s = np.matmul(q, k.transpose(0, 2, 1))
            s += self.mask
            if self.steep[0]:
                s -= s.max(axis=2, keepdims=True)
            np.exp(s, out=s)
            h = np.matmul(s, v)
            h /= s.sum(axis=2, keepdims=True)
            t = y[a + STRIDE : a + STRIDE + n * STRIDE]
            some = np.flatnonzero(t >= 0)
            t = t[some]
            state = np.ones((len(some), WIDTH + 1), np.float32)  # the last column takes the bias
            np.add(h.reshape(n * STRIDE, WIDTH)[some], g[STRIDE : STRIDE + n * STRIDE, 2 * HEAD + WIDTH :][some], out=state[:, :WIDTH])
            for i in range(0, len(t), BLOCK):
                own = t[i : i + BLOCK]
                z = state[i : i + BLOCK] @ self.out
                if self.steep[1]:
                    z -= z.max(axis=1, keepdims=True)
                hit = z[np.arange(len(own)), self.group[own]]
                np.exp(z, out=z)
                parts.append(hit - np.log(z @ ones) + self.inside[own])
        return np.concatenate(parts)

    def score(self, docs: list[np.ndarray], end: int) -> np.ndarray:
        """Natural-log probability of each document's ids and its end."""
        if not docs:
            return np.zeros(0)
        return np.add.reduceat(self.log_probs(docs, end), starts_of(docs))


def starts_of(docs: list[np.ndarray]) -> np.ndarray:
    """Where each document begins among all ids and ends."""
    return np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs[:-1]])]).astype(np.int64)


def phrases(docs: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts among all ids and ends, and 64-bit hashes, of the phrases of the documents; a document ends its last one."""
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return cut(_signs(end + 1)[np.concatenate([np.append(d, end) for d in docs])], starts_of(docs))


def cut(sign: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of a stream of 64-bit hashes of tokens, `first` being where its documents begin."""
    pair = sign.copy()
    pair[1:] += sign[:-1] * np.uint64(3)
    pair[first] = sign[first]
    opens = np.zeros(len(sign) + 1, bool)
    opens[1:] = (pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) < np.uint64((1 << 24) // PHRASE)
    opens = opens[:-1]
    opens[first] = True
    at = np.flatnonzero(opens)
    size = np.diff(np.append(at, len(sign)))
    power = np.cumprod(np.full(int(size.max()), 0xD6E8FEB86659FD93, np.uint64))
    return at, mix(np.add.reduceat(sign * power[np.arange(len(sign)) - np.repeat(at, size)], at))


@lru_cache(maxsize=2)
def _signs(ids: int) -> np.ndarray:
    return mix(np.arange(ids, dtype=np.uint64) + np.uint64(0x51ED270B7F4A7C15))


def neighbours(docs: list[np.ndarray], end: int, place: np.ndarray, cells: np.ndarray) -> None:
    """Add to cells (ids, 2, common + 1) how often a common id comes after and before each id of the documents."""
    if not docs:
        return
    stream = np.concatenate([np.append(d, end) for d in docs])
    inner = np.ones(len(stream) - 1, bool)
    inner[starts_of(docs)[1:] - 1] = False  # a document's end has nothing after it
    a, b = stream[:-1][inner], stream[1:][inner]
    wide = cells.shape[2]
    where = np.concatenate([a * (2 * wide) + place[b], b * (2 * wide) + wide + place[a]])
    cells += np.bincount(where, minlength=cells.size).reshape(cells.shape)


def places(count: np.ndarray, common: int = COMMON) -> np.ndarray:
    """Rank of the most common ids, `common` for all others."""
    top = np.argsort(-count, kind="stable")[:common]
    place = np.full(len(count), common)
    place[top] = np.arange(len(top))
    return place


def classes_of(count: np.ndarray, cells: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Classes of ids by k-means over what comes before and after them, and the reduced vectors; unseen ids share one."""
    ids = len(count)
    f = cells.reshape(ids, -1).astype(np.float32)
    mean = f.sum(axis=0, dtype=np.float64) / max(1, f.sum(dtype=np.float64))
    below = f.sum(axis=1, keepdims=True) + 4
    f += (4 * mean).astype(np.float32)
    f /= below
    np.sqrt(f, out=f)
    f -= np.sqrt(mean).astype(np.float32)
    cov = np.zeros((f.shape[1], f.shape[1]))
    for i in range(0, ids, 8192):
        w = f[i : i + 8192] * np.sqrt(count[i : i + 8192, None])
        cov += w.T @ w
    _, axes = np.linalg.eigh(cov)
    v = f @ axes[:, ::-1][:, :WIDTH]
    seen = np.flatnonzero(count)
    weight = count[seen].astype(float)
    k = min(CLASSES - 1, len(seen))
    centres = v[rng.choice(seen, k, replace=False, p=weight / weight.sum())] if k else v[:0]
    group = np.full(ids, CLASSES - 1)
    for _ in range(15 if k else 0):
        half = (centres**2).sum(axis=1) / 2
        own = (half - v[seen] @ centres.T).argmin(axis=1)
        group[seen] = own
        mass = np.bincount(own, weight, k)
        for j in range(WIDTH):
            centres[:, j] = np.where(mass > 0, np.bincount(own, weight * v[seen, j], k) / np.maximum(mass, 1e-9), centres[:, j])
    return group, v


class Trainer:
    """Adam (for the vectors of ids: Adagrad, one size an id) over all windows of whole documents."""

    def __init__(self, p: dict[str, np.ndarray], group: np.ndarray, end: int, held: np.ndarray | None = None):
        self.p, self.group, self.end = {k: x.copy() for k, x in p.items()}, group, end
        self.m1 = {k: np.zeros_like(x) for k, x in p.items() if k != "embed"}
        self.m2 = {k: np.zeros_like(x) for k, x in p.items() if k != "embed"}
        self.held = np.zeros(len(p["embed"]), np.float32) if held is None else held.copy()
        self.steps = self.windows = 0
        self.met = np.zeros(len(p["embed"]), np.int64)

    def learn(self, docs: list[np.ndarray], rate, each: int = CHUNK) -> None:
        """One pass over every window of the documents, `each` neighbouring ones a step; `rate` gives the step size."""
        if not docs:
            return
        x, y, _ = layout(docs, len(self.group) + 1, len(self.group), self.end)
        for a in range(0, len(x) - STRIDE, each * STRIDE):
            b = min(len(x), a + (each + 1) * STRIDE)
            if (y[a + STRIDE : b] >= 0).any():
                self.step(x[a:b], y[a + STRIDE : b], rate(self.windows))

    def step(self, x: np.ndarray, t: np.ndarray, rate: float) -> None:
        """One step on the windows of a stream `x`; `t` are the targets of all positions but the first STRIDE."""
        p, m1, m2, n = self.p, self.m1, self.m2, len(t) // STRIDE
        far = np.arange(STRIDE)[:, None] + STRIDE - np.arange(2 * STRIDE)[None, :]
        masked, dist = far < 0, np.clip(far, 0, 2 * STRIDE - 1)
        scale = np.float32(1 / np.sqrt(HEAD))
        e = p["embed"][x]
        eq, wide = e[STRIDE:], np.concatenate([p["wk"], p["wv"]], axis=1)
        kv, q = e @ wide, (eq @ (p["wq"] * scale)).reshape(n, STRIDE, HEAD)
        k, val = view(kv[:, :HEAD], 2 * STRIDE), view(kv[:, HEAD:], 2 * STRIDE)
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += np.where(masked, np.float32(-1e9), p["near"][dist])
        # as in `prepared`: norms bound the exponents
        norm = lambda x: float(np.sqrt(np.einsum("ij,ij->i", x, x).max()))
        if norm(q.reshape(-1, HEAD)) * norm(kv[:, :HEAD]) + float(np.abs(p["near"]).max()) > 75:
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(axis=2, keepdims=True)
        seen = np.matmul(a, val)
        h = seen.reshape(-1, WIDTH) + eq
        dh, g = np.empty_like(h), {"wo": np.zeros_like(p["wo"]), "bias": np.zeros_like(p["bias"])}
        ones, share = np.ones(CLASSES, np.float32), np.float32(1 / (t >= 0).sum())
        steep = norm(h) * norm(p["wo"].T) + float(np.abs(p["bias"]).max()) > 75
        for i in range(0, len(t), BLOCK):
            own, state = t[i : i + BLOCK], h[i : i + BLOCK]
            z = state @ p["wo"]
            z += p["bias"]
            if steep:
                z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z *= (np.where(own >= 0, share, np.float32(0)) / (z @ ones))[:, None]
            some = np.flatnonzero(own >= 0)
            z[some, self.group[own[some]]] -= share
            g["wo"] += state.T @ z
            g["bias"] += np.ones(len(z), np.float32) @ z
            np.matmul(z, p["wo"].T, out=dh[i : i + BLOCK])
        near = dh.reshape(n, STRIDE, WIDTH)
        dval = np.matmul(a.transpose(0, 2, 1), near)
        ds = np.matmul(near, val.transpose(0, 2, 1))
        ds -= (near * seen).sum(axis=2)[:, :, None]
        ds *= a
        g["near"] = np.bincount(dist[~masked], ds.sum(axis=0)[~masked], 2 * STRIDE).astype(np.float32)
        dq, dk = np.matmul(ds, k).reshape(-1, HEAD), np.matmul(ds.transpose(0, 2, 1), q)
        # a position's key and value serve two windows, the later half of one and the earlier half of the next
        dkv = np.zeros((n + 1, STRIDE, HEAD + WIDTH), np.float32)
        for part, d in ((slice(0, HEAD), dk), (slice(HEAD, None), dval)):
            dkv[:-1, :, part] = d[:, :STRIDE]
            dkv[1:, :, part] += d[:, STRIDE:]
        dkv = dkv.reshape(-1, HEAD + WIDTH)
        g["wq"], both = (eq.T @ dq) * scale, e.T @ dkv
        g["wk"], g["wv"] = both[:, :HEAD], both[:, HEAD:]
        de = dkv @ wide.T
        de[STRIDE:] += dh
        de[STRIDE:] += dq @ (p["wq"].T * scale)
        order = np.argsort(x.astype(np.uint16) if len(p["embed"]) <= 1 << 16 else x, kind="stable")
        ids = x[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        used = ids[first]
        ge = np.add.reduceat(de[order], first, axis=0)
        self.met[used] += np.diff(np.append(first, len(ids)))
        self.steps += 1
        self.windows += n
        for name, grad in g.items():
            m1[name] = 0.9 * m1[name] + 0.1 * grad
            m2[name] = 0.99 * m2[name] + 0.01 * grad * grad
            p[name] -= rate * (m1[name] / (1 - 0.9**self.steps)) / (np.sqrt(m2[name] / (1 - 0.99**self.steps)) + 1e-8)
        self.held[used] += (ge * ge).mean(axis=1)
        p["embed"][used] -= 8 * rate * ge / (np.sqrt(self.held[used]) + 1e-8)[:, None]

    def model(self, inside: np.ndarray) -> Attention:
        p = self.p
        return Attention(p["embed"], p["wq"], p["wk"], p["wv"], p["near"], p["wo"], p["bias"], self.group, inside)


def begin(counts: np.ndarray, end: int, cells: np.ndarray, seed: int = 7) -> tuple[Trainer, np.ndarray]:
    """Classes, probabilities within classes and first weights; `counts` of ids and `cells` are of all training texts."""
    ids, rng = len(counts), np.random.default_rng(seed)
    group, v = classes_of(counts, cells, rng)
    size = np.bincount(group, counts + 0.05, CLASSES)
    inside = np.log((counts + 0.05) / size[group])
    embed = np.concatenate([v / max(1e-9, v[counts > 0].std() if counts.any() else 0.0) * 0.5, rng.standard_normal((2, WIDTH)) * 0.1])
    p = {"wq": rng.standard_normal((WIDTH, HEAD)) * 0.2, "wk": rng.standard_normal((WIDTH, HEAD)) * 0.2, "wv": np.eye(WIDTH) * 0.3 + rng.standard_normal((WIDTH, WIDTH)) * 0.05, "near": np.zeros(2 * STRIDE), "wo": rng.standard_normal((WIDTH, CLASSES)) * 0.1, "bias": np.log(size / size.sum() + 1e-9), "embed": embed}
    return Trainer({k: x.astype(np.float32) for k, x in p.items()}, group, end), inside


def fit(docs: list[np.ndarray], counts: np.ndarray, end: int, epochs: int = 2, seed: int = 7) -> Attention:
    """Train on whole documents that one process holds; `counts` are of all training texts (end included)."""
    cells = np.zeros((len(counts), 2, COMMON + 1), np.int64)
    neighbours(docs, end, places(counts), cells)
    trainer, inside = begin(counts, end, cells, seed)
    for epoch in range(epochs):
        trainer.learn(docs, lambda _, epoch=epoch: 0.01 * min(1, (trainer.steps + 1) / 50) * (1 - 0.9 * epoch / epochs))
    return trainer.model(inside)


def refine(trained: DataFrame, trainer: Trainer, kind: str, windows: int) -> None:
    """Learn from every window of the (row, ids) of all training texts, `windows` by estimate, in rounds: in each, tasks
    go on from the weights at hand, and what they change is averaged, by windows for shared weights and by occurrences for
    the vectors of ids. Few windows are one round of several passes."""
    few = windows < EPOCHS
    bucket, low = F.pmod(F.xxhash64(F.lit(7), "row"), F.lit(16)), 0
    for share, fast, slow in ((16, ROUNDS[0][1], ROUNDS[-1][2]),) if few else ROUNDS:
        own = trained if share == 16 else trained.filter((bucket >= low) & (bucket < low + share))
        _round(own.select("ids"), trainer, kind, windows * share // 16, fast, slow, min(4, -(-EPOCHS // max(1, windows))) if few else 1)
        low += share


def _round(trained: DataFrame, trainer: Trainer, kind: str, windows: int, fast: float, slow: float, passes: int) -> None:
    shared = trained.sparkSession.sparkContext.broadcast((trainer.p, trainer.held, trainer.group, trainer.end))
    names = [k for k in trainer.p if k != "embed"]
    columns = [f"d{j}" for j in range(WIDTH)] + ["held"]
    tasks = max(1, windows // TASK)
    each = min(CHUNK, max(32, windows // 64))
    todo = max(1, windows * passes // tasks)

    def run(batches):
        p, held, group, end = shared.value
        own = Trainer(p, group, end, held)
        rate = lambda done: (fast + (slow - fast) * min(1, done / todo)) * min(1, (own.steps + 1) / 20)
        for b in pieces(batches, 2048):
            docs = ids_of(b.column(0), kind)
            for _ in range(passes):
                own.learn(docs, rate, each)
        if not own.windows:
            return
        flat = np.concatenate([(own.p[k] - p[k]).ravel() for k in names])
        flat = np.pad(flat, (0, -len(flat) % WIDTH)).reshape(-1, WIDTH)
        used = np.flatnonzero(own.met)
        change = np.concatenate([np.pad(flat, ((0, 0), (0, 1))), np.column_stack([own.p["embed"][used] - p["embed"][used], own.held[used] - held[used]])])
        at, weight = np.concatenate([-1 - np.arange(len(flat)), used]), np.concatenate([np.full(len(flat), own.windows), own.met[used]])
        for i in range(0, len(at), 4096):
            yield batch(at=at[i : i + 4096], weight=weight[i : i + 4096], **{c: change[i : i + 4096, j].astype(np.float32) for j, c in enumerate(columns)})

    moved = trained.coalesce(tasks).mapInArrow(run, "at long, weight long, " + ", ".join(f"{c} float" for c in columns))
    told = moved.groupBy("at").agg(*[(F.sum(F.col(c) * F.col("weight").cast("double")) / F.sum("weight")).cast("float").alias(c) for c in columns]).toArrow()  # at most a row an id
    shared.destroy()
    at, change = told["at"].to_numpy(), np.stack([told[c].to_numpy() for c in columns], axis=1)
    trainer.p["embed"][at[at >= 0]] += change[at >= 0, :WIDTH]
    trainer.held[at[at >= 0]] += change[at >= 0, WIDTH]
    flat = np.zeros((int(-at.min(initial=0)), WIDTH), np.float32)
    flat[-1 - at[at < 0]] = change[at < 0, :WIDTH]
    flat, used = flat.ravel(), 0
    for k in names if len(flat) else []:
        x = trainer.p[k]
        x += flat[used : used + x.size].reshape(x.shape)
        used += x.size


def ids_of(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind).astype(np.int64) for x in column]


def summed(rows: DataFrame, hashes) -> DataFrame:
    """Hash and count of what `hashes` finds in batches of the rows; tasks add up their own part before the shuffle."""

    def run(batches):
        held, size = [], 0

        def out():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return batch(h=h.view(np.int64), n=n.astype(np.int64))

        for b in pieces(batches, 2048):
            held.append(hashes(b.column(0)))
            size += len(held[-1])
            if size > 6_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return rows.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _word_hashes(text: pa.Array) -> np.ndarray:
    words = Words(text)
    return words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)


def listed_from(counts: DataFrame, total: int) -> int:
    """The least count, 2 or more, that a word or phrase of a shared table has: those of FREQUENT of the total are in it,
    and rarer ones while it has at most LISTED rows."""
    top = max(2, math.ceil(FREQUENT * total))
    least, rows = top, 0
    for n, many in sorted(counts.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count("*")).collect(), reverse=True):  # at most `top` rows
        rows += many
        if n < 2 or n < top and rows > LISTED:
            break
        least = n
    return least


def common_table(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and counts, of those counted `least` times or more, at most LISTED."""
    told = counts.filter(F.col("n") >= least).toArrow()
    names = told["h"].to_numpy().view(np.uint64)
    order = np.argsort(names)
    return names[order], told["n"].to_numpy()[order]


def located(names: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes among the sorted `names` of a common table, -1 for others."""
    if not len(names):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
    return np.where(names[at] == h, at, -1)


def found(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Counts of the hashes in a common table, 0 for others."""
    at = located(table[0], h)
    return np.where(at >= 0, np.append(table[1], 0)[at], 0)


def score(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32(doc_id as text) mod 7 is not 2 train; what a training text itself adds to the memory of phrases
    is left out of its own score. Null and empty texts are one end token; rows with a null doc_id are scored and train
    nothing; repeated rows are rows of their own; other columns are ignored; an empty table gives an empty result, and
    without training texts every word is unknown and the model is uniform over classes. Weights depend on how the rows
    are dealt to partitions. Nothing is learned from a sample: `sample` is taken from older callers and has no effect.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"))
    own = ~F.col("held_out") & F.col("doc_id").isNotNull()
    train = rows.filter(own)
    counts = staged(summed(train.select("text"), _word_hashes), "words")
    texts = train.count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = words + texts, distinct + (1 if texts else 0)
    least = listed_from(counts, n)
    names, times = common_table(counts, least)
    top = np.lexsort((names, -times))[:OWN]
    other, end = len(top), len(top) + 1  # ids of all words without a vector of their own, and of the end
    ids = np.full(len(names), other)
    ids[top] = np.arange(other)
    mass = int(words - times[top].sum())
    every = np.concatenate([times[top], [mass, texts]])
    # log10 probability of a word among the others: by its count, or an equal part of what words outside the table have
    spell = np.append(np.where(ids == other, np.log10(times / (mass + 1)), 0.0), np.log10((words - times.sum() + 1) / (mass + 1) / (distinct - len(names) + 1)))
    shared = spark.sparkContext.broadcast((names, np.append(times, 0), np.append(ids, other).astype(np.int32), spell.astype(np.float32)))
    unit = np.log10(n + 1.0 * (v + 1))
    size = end + 1
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def prepare(batches):
        names, times, ids, spell = shared.value
        row = TaskContext.get().partitionId() << 33
        for b in pieces(batches):
            w = Words(b.column(1))
            h, doc = w.hashes(), w.docs()
            at = located(names, h)  # -1 takes the last entry: no count, another word
            c, rare = times[at], (at < 0)[w.codes]
            base, seen = np.bincount(doc, np.log10(c + 1.0)[w.codes], b.num_rows), np.bincount(doc, (c > 0)[w.codes], b.num_rows)
            place, first = np.arange(len(doc)) + doc, w.offsets[:-1] + np.arange(b.num_rows)
            sign, lp = np.full(len(doc) + b.num_rows, 0x51ED270B7F4A7C15, np.uint64), np.zeros(len(doc) + b.num_rows)
            sign[place], lp[place] = mix(h)[w.codes], spell[at][w.codes]
            begins, hashes = cut(sign, first)
            ends = np.searchsorted(begins, np.append(first, len(sign)))
            listed = lambda x, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))
            tail = listed(h[w.codes[rare]].view(np.int64), np.concatenate([[0], np.cumsum(rare)])[w.offsets])
            own = ids[at][w.codes].astype(kind)
            yield batch(
                row=pa.array(np.arange(row, row + b.num_rows)), doc_id=b.column(0), held_out=b.column(2), n_words=w.counts.astype(np.int64), known=seen.astype(np.int64),
                base=base + np.log10(texts + 1.0) - unit * (w.counts + 1), tail=tail, ids=binary([own[x:y] for x, y in zip(w.offsets[:-1], w.offsets[1:], strict=True)]),
                phrases=listed(hashes.view(np.int64), ends), begins=listed((begins - np.repeat(first, np.diff(ends))).astype(np.int32), ends), spell=listed(np.add.reduceat(lp, begins).astype(np.float32), ends),
            )
            row += b.num_rows

    schema = "row long, doc_id long, held_out boolean, n_words long, known long, base double, tail array<long>, ids binary, phrases array<long>, begins array<int>, spell array<float>"
    encoded = staged(rows.select("doc_id", "text", "held_out").mapInArrow(prepare, schema), "encoded", compression="zstd")
    trained = encoded.filter(own)
    place = spark.sparkContext.broadcast(places(every))

    def met(batches):
        cells = np.zeros((size, 2, COMMON + 1), np.int64)
        for b in pieces(batches, 2048):
            neighbours(ids_of(b.column(0), kind), end, place.value, cells)
        flat = cells.reshape(-1)
        some = np.flatnonzero(flat)
        for i in range(0, len(some), 65536):
            yield batch(cell=some[i : i + 65536].astype(np.int32), n=flat[some[i : i + 65536]])

    told = trained.select("ids").mapInArrow(met, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most ids times 2 * (COMMON + 1) rows
    cells = np.zeros((size, 2, COMMON + 1), np.float32)
    cells.reshape(-1)[told["cell"].to_numpy()] = told["n"].to_numpy()
    del told
    trainer, inside = begin(every, end, cells)
    del cells
    give_back()
    refine(trained.select("row", "ids"), trainer, kind, n // STRIDE + texts)
    model = spark.sparkContext.broadcast(trainer.model(inside))

    memory = staged(trained.select(F.explode("phrases").alias("h")).groupBy("h").agg(F.count("*").alias("n")), "phrases")
    total = memory.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = listed_from(memory, total)
    recalled = spark.sparkContext.broadcast(common_table(memory, often))
    spelled = np.log10(1 - RECALL) if total else 0.0

    def run(batches):
        net = model.value.prepared()
        for b in pieces(batches, 512):
            texts = ids_of(b.column(1), kind)
            lp = net.log_probs(texts, end) / np.log(10)
            many = pc.list_value_length(b.column(7)).to_numpy()
            h, begins, spell = (b.column(k).flatten().to_numpy() for k in (7, 8, 9))
            h, doc = h.view(np.uint64), np.repeat(np.arange(b.num_rows), many)
            lp = np.add.reduceat(lp, starts_of(texts)[doc] + begins) + spell + spelled
            learned = b.column(3).is_valid().to_numpy(zero_copy_only=False) & ~b.column(2).to_numpy(zero_copy_only=False)
            _, place, times = np.unique(h ^ mix(doc.astype(np.uint64)), return_inverse=True, return_counts=True)
            mine = np.where(learned[doc], times[place], 0)
            c = found(recalled.value, h)
            # what is not in the table was counted less than `often` times; where all of these are the text's own, nothing is asked
            rare, others = (c == 0) & (mine < often - 1), np.maximum(c - mine, 0)
            lp += np.where(others > 0, gain(others, total, lp), 0)
            ends = np.concatenate([[0], np.cumsum(rare)])[np.concatenate([[0], np.cumsum(many)])]
            cells = pa.StructArray.from_arrays([pa.array(h[rare].view(np.int64)), pa.array(lp[rare].astype(np.float32)), pa.array(mine[rare].astype(np.int32))], names=["h", "lp", "mine"])
            yield batch(row=b.column(0), doc_id=b.column(3), held_out=b.column(2), n_words=b.column(4), known=b.column(5), base=b.column(6), score=np.bincount(doc, lp, b.num_rows), phrases=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells))

    schema = "row long, doc_id long, held_out boolean, n_words long, known long, base double, score double, phrases array<struct<h: long, lp: float, mine: int>>"
    scored = staged(encoded.select("row", "ids", "held_out", "doc_id", "n_words", "known", "base", "phrases", "begins", "spell").mapInArrow(run, schema), "scored", compression="zstd")

    # what is too rare for the shared tables meets its count by hash: words add to the base, phrases to the score
    asked = encoded.select("row", F.explode("tail").alias("h")).select("row", "h", F.lit(None).cast("float").alias("lp"), F.lit(0).alias("mine"))
    asked = asked.unionByName(scored.select("row", F.explode("phrases").alias("p")).select("row", "p.h", "p.lp", "p.mine"))
    known = counts.filter(F.col("n") < least).withColumn("word", F.lit(True)).unionByName(memory.filter((F.col("n") < often)).withColumn("word", F.lit(False)))
    asked = asked.join(known, "h").filter(F.col("word") == F.col("lp").isNull())
    others = F.col("n") - F.col("mine")
    d = F.log10(others * float(RECALL / max(total, 1))) - F.col("lp")
    more = F.when(others > 0, F.greatest(d, F.lit(0.0)) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(d))))
    rare = asked.groupBy("row").agg(F.sum(F.when(F.col("word"), F.log10(F.col("n") + 1.0))).alias("more"), F.count(F.when(F.col("word"), 1)).alias("also"), F.sum(F.when(~F.col("word"), more)).alias("gained"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return scored.drop("phrases").join(rare, "row", "left").select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + F.coalesce("also", F.lit(0)) + (1 if texts else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + none("more")).alias("base_score"), (F.col("score") + none("gained")).alias("score"),
    )


def gain(others: np.ndarray, total: int, lp: np.ndarray) -> np.ndarray:
    """What recall adds to phrases' log10 probability `lp` by spelling: log10(1 + recalled / spelled)."""
    d = np.log10(np.maximum(others, 1) * (RECALL / max(total, 1))) - lp
    return np.maximum(d, 0) + np.log10(1 + 10 ** -np.abs(d))
