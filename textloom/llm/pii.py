"""Personal data: a character BiLSTM with a CRF on top, trained in numpy from labelled spans."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from pathlib import Path
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import per_document, pieces

KINDS = ("email", "phone", "card", "ip", "ssn", "iban")
#: Tag 0 is none, k + 1 a character of a span of kind k. Two spans of a kind never touch, so none marks a beginning.
TAGS = len(KINDS) + 1
#: Characters of a window, and how many it shares with the next.
WINDOW, OVERLAP = 512, 64
#: Windows that are tagged at once.
TOGETHER = 512
#: Cells a direction, the training's samples and seed, and its phases: rounds, characters of a sample and samples of a batch.
HIDDEN, SAMPLES, SEED = 16, 16000, 11
PHASES = ((7, 64, 128), (4, 256, 48))

#: The fitted weights, some 50 kB.
WEIGHTS = Path(__file__).with_name("pii_weights.npz")

_SIGNS = "@.-+() \n_:/\"=#!,"
CLASSES = 1 + 26 + 26 + 1 + 1 + len(_SIGNS) + 1


def _class_table() -> np.ndarray:
    """Class of each code point below 0x3000: 0 is padding; small and capital letters from a to z have one each, digits one together, as have other letters and other signs."""
    table = np.full(0x3001, CLASSES - 1, np.int16)
    for code in range(0x3000):
        c = chr(code)
        if "a" <= c <= "z":
            table[code] = code - 96
        elif "A" <= c <= "Z":
            table[code] = code - 38
        elif c.isdigit():
            table[code] = 54
        elif c.isalpha():
            table[code] = 53
        elif c in _SIGNS:
            table[code] = 55 + _SIGNS.index(c)
    table[0x3000] = 53
    return table


TABLE = _class_table()


def classes(text: str) -> np.ndarray:
    return TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x3000)]


# Labelled spans

#: Common pairs and threes of letters, of which made-up words are put together besides random letters and syllables.
PARTS = "al an and ar as at be ch de ed en er es ha he ic in ing io is it le ll ma me nd ne ng nt of on or ou ra re ri ro se st te th the ti tion to ur ve wh ly".split()


def labelled(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n made-up lines with the (start, end, kind) of their spans, among them dates, times, versions, prices, ratios, ISBNs, order numbers, hex strings and numbers that are none, and prose in several scripts."""
    rng = Random(seed)
    some = rng.randrange

    def pick(*options):
        return options[int(rng.random() * len(options))]

    def digits(k: int) -> str:
        return f"{some(10**k):0{k}d}"

    def plain(k: int) -> str:
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))

    def capitals(k: int) -> str:
        return plain(k).upper()

    def syllables(k: int, vowels: str) -> str:
        return "".join(rng.choice("bcdfghklmnprstvwz") + rng.choice(vowels) for _ in range(k))

    def name() -> str:
        return syllables(some(1, 5), "aeiou") + pick("", "", "n", "s", "r")

    def word() -> str:
        r = rng.random()
        if r < 0.25:
            return plain(some(1, 11))
        if r < 0.33:
            low, high = pick((0x430, 0x44F), (0x3B1, 0x3C9), (0x4E00, 0x9FA0), (0x627, 0x648), (0xE0, 0xFE))
            return "".join(chr(some(low, high)) for _ in range(some(1, 9))) + pick("", "", ",", ".")
        w = syllables(some(1, 6), "aeiouéüñ") if r < 0.6 else "".join(rng.choices(PARTS, k=some(1, 7)))
        return pick(w, w, w, w.capitalize(), w + ",", w + ".", f"({w})", w + ":", w + "-" + plain(3), w + "'s", w + "/" + plain(2), w.upper(), w + "." + plain(4).capitalize())

    def email() -> str:
        one = lambda: pick(plain, lambda k: name())(some(1, 9))
        user = pick(one, one, lambda: one() + "." + one(), lambda: one() + "_" + one(), lambda: one() + "-" + one(), lambda: f"{one()}.{one()}-{one()}", lambda: one() + "+" + one())()
        user += pick("", "", "", "." + digits(2), digits(some(1, 5)))
        host = pick(name, name, lambda: plain(some(2, 9)), lambda: "mail", lambda: "post")() + pick("", "", digits(1), "-" + plain(3))
        return f"{user}@{host}.{pick('example.', '', '', name() + '.', 'co.')}{pick('com', 'org', 'net', 'de', 'fr', 'es', 'info', 'edu', 'shop', plain(2), plain(3), plain(some(2, 7)))}"

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        country = "+" + digits(some(1, 4))
        local = pick(f"{digits(2)} {digits(4)} {digits(4)}", f"{digits(3)} {digits(6)}", f"{a} {b} {c}", f"{digits(4)} {digits(6)}", f"{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", digits(some(8, 12)), f"({digits(some(2, 4))}) {digits(some(6, 9))}", f"{digits(2)}-{digits(4)}-{digits(4)}", f"{a} {b}-{digits(2)}-{digits(2)}")
        return pick(
            f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}", f"{country} {local}", f"{country} {local}", f"{country}-{a}-{digits(some(5, 8))}",
            f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(3)} {digits(some(6, 9))}", f"0{digits(3)}/{digits(some(5, 8))}", f"0{digits(3)}-{digits(some(6, 8))}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0{digits(4)} {digits(6)}", " ".join([f"0{digits(1)}", *(digits(2) for _ in range(4))]),
        )

    def card() -> str:
        q = [digits(4) for _ in range(4)]
        return pick("".join(q), "".join(q), "".join(q), "".join(q), " ".join(q), "-".join(q), f"{q[0]} {digits(6)} {digits(5)}", f"{q[0]} {digits(6)} {digits(5)}")

    def ip() -> str:
        return ".".join(map(str, pick([some(256) for _ in range(4)], [some(256) for _ in range(4)], [some(20) for _ in range(4)], (10, some(256), some(30), some(10)), (192, 168, some(10), some(256)))))

    def ssn() -> str:
        return f"{digits(3)}-{digits(2)}-{digits(4)}"

    def iban() -> str:
        country = capitals(2)
        body = pick("", "", capitals(4)) + digits(some(12, 23))
        whole = country + digits(2) + body
        return whole if rng.random() < 0.4 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def other() -> str:
        date = (some(1950, 2050), some(1, 13), some(1, 29))
        hexa = "".join(rng.choices("0123456789abcdef", k=some(8, 42)))
        return pick(
            f"{date[0]}-{date[1]:02d}-{date[2]:02d}", f"{date[2]}.{date[1]}.{date[0]}", f"{date[1]:02d}/{date[2]:02d}/{date[0]}", f"{digits(1)}.{digits(1)}", f"{digits(1)}.", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}",
            f"${digits(3)}.{digits(2)}", f"{digits(1)},{digits(3)}.{digits(2)}", f"{digits(2)},{digits(3)},{digits(3)}", digits(some(1, 9)), digits(some(5, 14)), digits(some(19, 40)), f'token = "{hexa}"', f'"{hexa}"', f"#{digits(4)}", f"({digits(4)})", "@ " + word(), "@" + plain(5), f"{word()} @", f"{word()} {digits(2)} {digits(3)}", f"{name().capitalize()} {digits(some(1, 6))}", f"{name().upper()}{digits(some(1, 9))}", capitals(4) + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)),
            f"CC BY-NC {digits(1)}.0.", f"{digits(2)}%", f"{plain(3)}{digits(2)}", f"id={digits(6)}", hexa.upper(), hexa, f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"ISBN {digits(13)}", f"{digits(4)}-{digits(4)}", f"{date[0]}-{date[0] + 3}", f"{digits(3)}-{digits(3)}", f"{digits(1)}:{digits(1)}", f"{digits(2)} {pick('kg', 'km', 'cm', 'EUR')}",
            f"https://{name()}.{plain(3)}/{plain(4)}/{digits(some(1, 7))}", f"www.{name()}.{plain(3)}", f"§{digits(2)}", f"{digits(2)}.{digits(6)}", f"{digits(3)} {digits(3)}", f"{capitals(2)}-{digits(5)}", f"{hexa[:8]}-{hexa[:4]}-{digits(4)}-{hexa[-4:]}-{plain(2)}{digits(6)}", f"pp. {digits(2)}-{digits(3)}", f"{digits(1)}.{digits(1)}.", f"*** {digits(2)}", "...", "-----", "=====", "+++", "###",
        )

    made = {"email": email, "phone": phone, "card": card, "ip": ip, "ssn": ssn, "iban": iban}
    out = []
    for _ in range(n):
        text, spans, tail = "", [], pick("", "", "", "", "", "###", "!!", "%%%", "$$$", "***", "&&&")
        upper, share = rng.random() < 0.08, pick(0.0, 0.05, 0.12, 0.25)
        for _ in range(some(5, 60)):
            r = rng.random()
            if r < share:
                kind = KINDS[some(0, len(KINDS))]
                piece = made[kind]()
                before = pick("", "", "", "", "(", '"', ":", "<", "tel:", "=", "[")
                spans.append((len(text) + len(before), len(text) + len(before) + len(piece), kind))
                text += before + piece + (tail or pick("", "", "", "", ".", ",", ")", '"', ";", ">", ":", "?", "]"))
            elif r < share + 0.16:
                text += other() + tail
            else:
                text += word() + tail
            text += pick(" ", " ", " ", " ", " ", "\n", "  ", "\n\n")
        out.append((text.upper() if upper and len(text.upper()) == len(text) else text, spans))
    return out


def tags(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for a, b, kind in spans:
        y[a:b] = KINDS.index(kind) + 1
    return y


# The network


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


def lse(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis=axis, keepdims=True)
    return np.log(np.exp(z - top).sum(axis=axis)) + np.squeeze(top, axis)


@dataclass
class Tagger:
    """given: each class's input to the gates of both directions; cell: the recurrent weights; out, bias: to the tags; move, first, last: the CRF's."""

    given: np.ndarray
    cell: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    move: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @staticmethod
    def start(seed: int = SEED, hidden: int = HIDDEN) -> Tagger:
        rng = np.random.default_rng(seed)
        f = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        given = f(2, CLASSES, 4 * hidden, by=0.3)
        given[:, :, hidden : 2 * hidden] += 1  # forget gates start open
        return Tagger(given, f(2, hidden, 4 * hidden, by=hidden**-0.5), f(2 * hidden, TAGS, by=0.2), f(TAGS, by=0), f(TAGS, TAGS, by=0.1), f(TAGS, by=0.1), f(TAGS, by=0.1))

    def parts(self) -> list[np.ndarray]:
        return [self.given, self.cell, self.out, self.bias, self.move, self.first, self.last]

    def run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Scores of the tags (batch, time, tags) and, if kept, what learning needs."""
        n, t = x.shape
        h = self.cell.shape[1]
        both = np.stack([x, x[:, ::-1]])
        state, memory = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        states, gates, memories = np.empty((t, 2, n, h), np.float32), [], []
        for k in range(t):
            z = np.matmul(state, self.cell)
            z[0] += self.given[0][both[0, :, k]]
            z[1] += self.given[1][both[1, :, k]]
            s = sigmoid(z[:, :, : 3 * h])
            i, f, o, g = s[:, :, :h], s[:, :, h : 2 * h], s[:, :, 2 * h :], np.tanh(z[:, :, 3 * h :])
            if keep:
                gates.append((i, f, o, g))
                memories.append(memory)
            memory = f * memory + i * g
            state = o * np.tanh(memory)
            states[k] = state
        memories.append(memory)
        joined = np.concatenate([states[:, 0], states[::-1, 1]], axis=2).transpose(1, 0, 2)
        return joined @ self.out + self.bias, (both, states, gates, memories, joined)

    def learn(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradients."""
        scores, (both, states, gates, memories, joined) = self.run(x, keep=True)
        n, t, k = scores.shape
        alpha, beta = np.empty_like(scores), np.empty_like(scores)
        alpha[:, 0], beta[:, -1] = self.first + scores[:, 0], self.last
        for j in range(1, t):
            alpha[:, j] = lse(alpha[:, j - 1, :, None] + self.move, 1) + scores[:, j]
        for j in range(t - 2, -1, -1):
            beta[:, j] = lse(self.move + (scores[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
        total = lse(alpha[:, -1] + self.last, 1)
        rows = np.arange(n)[:, None]
        gold = scores[rows, np.arange(t), y].sum(1) + self.first[y[:, 0]] + self.last[y[:, -1]] + self.move[y[:, :-1], y[:, 1:]].sum(1)
        marginal = np.exp(alpha + beta - total[:, None, None])
        truth = np.eye(k, dtype=np.float32)[y]
        d_scores = (marginal - truth) / n
        pair = alpha[:, :-1, :, None] + self.move + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        d_move = np.exp(pair).sum((0, 1)) / n
        np.add.at(d_move, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1 / n)
        d_out, d_bias = joined.reshape(-1, joined.shape[2]).T @ d_scores.reshape(-1, k), d_scores.sum((0, 1))
        d_joined = (d_scores @ self.out.T).transpose(1, 0, 2)
        h = self.cell.shape[1]
        d_states = np.stack([d_joined[:, :, :h], d_joined[::-1, :, h:]], axis=1)
        d_given, d_cell = np.zeros_like(self.given), np.zeros_like(self.cell)
        d_state, d_memory = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        turned = self.cell.transpose(0, 2, 1)
        for j in range(t - 1, -1, -1):
            i, f, o, g = gates[j]
            d_state = d_state + d_states[j]
            now = np.tanh(memories[j + 1])
            d_memory = d_memory + d_state * o * (1 - now * now)
            dz = np.concatenate([d_memory * g * i * (1 - i), d_memory * memories[j] * f * (1 - f), d_state * now * o * (1 - o), d_memory * i * (1 - g * g)], axis=2)
            d_memory = d_memory * f
            if j:
                d_cell += np.matmul(states[j - 1].transpose(0, 2, 1), dz)
            for d in (0, 1):
                d_given[d] += np.eye(CLASSES, dtype=np.float32)[both[d, :, j]].T @ dz[d]
            d_state = np.matmul(dz, turned)
        return float((total - gold).mean()), [d_given, d_cell, d_out, d_bias, d_move, d_scores[:, 0].sum(0), d_scores[:, -1].sum(0)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """What run() gives, as (time, tags, batch), and faster: gates lie apart, every sigmoid and tanh is 1 / (1 + exp(z)) with its factors in the weights, and each step writes where the one before did."""
        n, t = x.shape
        h = self.cell.shape[1]
        factors = np.array([-1, -1, -1, -2], np.float32)[:, None, None]
        apart = lambda w: np.ascontiguousarray(w.reshape(2, -1, 4, h).transpose(0, 2, 1, 3)) * factors
        given, cell = apart(self.given).reshape(-1, h), apart(self.cell) * np.float32(2)  # a state is kept half as large
        first = (np.arange(8, dtype=np.intp) * CLASSES).reshape(2, 4, 1)
        ahead = np.ascontiguousarray(x.T, np.intp)
        rows = np.empty((2, 4, n), np.intp)
        z, input_ = np.empty((2, 4, n, h), np.float32), np.empty((2, 4, n, h), np.float32)
        memory, part = np.zeros((2, n, h), np.float32), np.empty((2, n, h), np.float32)  # memory is kept times -2
        states = np.empty((t, 2, n, h), np.float32)
        i, f, o, g = (z[:, k] for k in range(4))
        with np.errstate(over="ignore"):  # an infinite exp is a gate of 0
            for k in range(t):
                np.add(first[0], ahead[k], out=rows[0])
                np.add(first[1], ahead[t - 1 - k], out=rows[1])
                given.take(rows, axis=0, out=input_, mode="clip")
                if k:
                    np.matmul(states[k - 1][:, None], cell, out=z)
                    z += input_
                    np.exp(z, out=z)
                else:
                    np.exp(input_, out=z)
                z += np.float32(1)
                np.reciprocal(z, out=z)
                g *= np.float32(-4)
                g += np.float32(2)
                memory *= f
                np.multiply(i, g, out=part)
                memory += part
                np.exp(memory, out=part)
                part += np.float32(1)
                np.reciprocal(part, out=part)
                part -= np.float32(0.5)
                np.multiply(o, part, out=states[k])
        twice = np.ascontiguousarray((self.out * np.float32(2)).T)
        found = np.matmul(twice[:, :h], states[:, 0].transpose(0, 2, 1))
        found += np.matmul(twice[:, h:], states[::-1, 1].transpose(0, 2, 1))
        found += self.bias[:, None]
        return found

    def best(self, x: np.ndarray) -> np.ndarray:
        """The most likely tags of each row (Viterbi): the best scores forward, and the way back along the best path only, which is known already where none is best followed by none throughout."""
        at = self.scores(x)
        t, k, n = at.shape
        at[0] += self.first[:, None]
        top, one = np.empty((k, n), np.float32), np.empty((k, n), np.float32)
        none, same, stay = np.ones(n, bool), np.empty(n, bool), np.empty(n, np.float32)
        for j in range(1, t):
            np.add(at[j - 1, 0], self.move[0][:, None], out=top)
            stay[:] = top[0]
            for p in range(1, k):
                np.add(at[j - 1, p], self.move[p][:, None], out=one)
                np.maximum(top, one, out=top)
            np.equal(stay, top[0], out=same)
            none &= same
            at[j] += top
        last = (at[-1] + self.last[:, None]).argmax(0)
        y = np.zeros((t, n), np.int64)
        left = np.flatnonzero(~none | (last > 0))
        if len(left):
            at = np.ascontiguousarray(at[:, :, left])
            way = np.empty((t, len(left)), np.int64)
            way[-1] = last[left]
            into = np.ascontiguousarray(self.move.T)
            for j in range(t - 1, 0, -1):
                way[j - 1] = (at[j - 1] + into[way[j]].T).argmax(0)
            y[:, left] = way
        return y.T


def samples(rows: list[tuple[str, list[tuple[int, int, str]]]], length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Each line cut at a random place to the length, or padded at its end."""
    rng = np.random.default_rng(seed)
    x, y = np.zeros((len(rows), length), np.int16), np.zeros((len(rows), length), np.int64)
    for i, (text, spans) in enumerate(rows):
        c, t = classes(text), tags(len(text), spans)
        at = int(rng.integers(0, max(1, len(c) - length + 1)))
        n = min(length, len(c) - at)
        x[i, :n], y[i, :n] = c[at : at + n], t[at : at + n]
    return x, y


def fit(rows: list[tuple[str, list[tuple[int, int, str]]]], phases: tuple[tuple[int, int, int], ...] = PHASES, seed: int = SEED) -> Tagger:
    """Adam over shuffled batches, short samples first, then long ones; the same rows and seed give the same model."""
    model = Tagger.start(seed)
    rng = np.random.default_rng(seed)
    m, v = ([np.zeros_like(p) for p in model.parts()] for _ in range(2))
    rounds = [(length, batch) for n, length, batch in phases for _ in range(n)]
    step, steps = 0, sum(len(rows) // batch for _, batch in rounds)
    for r, (length, batch) in enumerate(rounds):
        x, y = samples(rows, length, seed + r)
        order = rng.permutation(len(x))
        for at in range(0, len(x) - batch + 1, batch):
            _, grads = model.learn(x[order[at : at + batch]], y[order[at : at + batch]])
            step += 1
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
            rate = 0.015 * (1 - step / (steps + 1)) * min(1, step / 20)
            for p, g, a, b in zip(model.parts(), grads, m, v, strict=True):
                g = g * min(1, 5 / max(norm, 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (rate / (1 - 0.9**step)) * a / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


def settings() -> str:
    """What the fitted weights depend on: the sizes and a digest of the generator's lines."""
    return f"{KINDS} {CLASSES} {HIDDEN} {SAMPLES} {SEED} {PHASES} {sha256(repr(labelled(200, SEED)).encode()).hexdigest()}"


def save(model: Tagger, path: Path = WEIGHTS) -> None:
    np.savez_compressed(path, *model.parts(), settings=np.array(settings()))


@lru_cache(maxsize=1)
def train() -> Tagger:
    """The model of the registered query: the weights that `python -m textloom.llm.pii` has fitted and saved beside this module, as long as they belong to these settings, else fitted here, in some minutes."""
    if WEIGHTS.exists():
        with np.load(WEIGHTS) as held:
            if str(held["settings"]) == settings():
                return Tagger(*(held[f"arr_{k}"] for k in range(7)))
    return fit(labelled(SAMPLES, SEED))


# Windows and their reconciliation


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Windows of WINDOW characters over [start, end), each sharing OVERLAP with the one before it."""
    last = max(start, end - OVERLAP)
    return [(a, min(a + WINDOW, end)) for a in range(start, last if last > start else start + 1, WINDOW - OVERLAP)]


def reconcile(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) out of the windows' (start, end, kind, room, id of the window).

    A span that two windows see alike counts once. Where spans overlap, those are kept that have the most room to the edges of
    their windows in total, over the whole text: the best set of disjoint spans, by dynamic programming; a span cut off by
    an edge has no room and is kept only where no window saw more of it. Kept spans of one kind that abut and are cut off
    on both sides of an edge are one.
    """
    most: dict[tuple[int, int, int], int] = {}
    for a, b, k, room, _ in found:
        most[a, b, k] = max(most.get((a, b, k), 0), room)
    spans = sorted(most, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in spans]
    best: list[tuple[int, int]] = [(0, 0)]
    took: list[int] = []
    for i, s in enumerate(spans):
        j = bisect_right(ends, s[0], 0, i)
        worth = (best[j][0] + 1 + OVERLAP * most[s], best[j][1] + s[1] - s[0])
        if worth > best[i]:
            best.append(worth)
            took.append(j)
        else:
            best.append(best[i])
            took.append(-1)
    out, i = [], len(spans)
    while i:
        if took[i - 1] >= 0:
            out.append(spans[i - 1])
            i = took[i - 1]
        else:
            i -= 1
    out.reverse()
    joined: list[tuple[int, int, int]] = []
    for a, b, k in out:
        if joined and joined[-1][1] == a and joined[-1][2] == k and not (most[joined[-1]] if joined[-1] in most else 0) and not most[a, b, k]:
            joined[-1] = (joined[-1][0], b, k)
        else:
            joined.append((a, b, k))
    return joined


def tag(model: Tagger, texts: list[str | None], together: int = TOGETHER) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the spans of each text, all of whose characters the network reads. Windows of like length go together, so that few are padded."""
    codes = [classes(t) if t else None for t in texts]
    cut = [(i, a, b) for i, c in enumerate(codes) if c is not None for a, b in windows(0, len(c))]
    cut.sort(key=lambda w: w[2] - w[1])
    found: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
    for at in range(0, len(cut), together):
        some = cut[at : at + together]
        x = np.zeros((len(some), some[-1][2] - some[-1][1]), np.int16)
        for r, (i, a, b) in enumerate(some):
            x[r, : b - a] = codes[i][a:b]
        y = model.best(x)
        if not y.any():
            continue
        starts = (y > 0) & (y != np.pad(y, ((0, 0), (1, 0)))[:, :-1])
        for r, c in zip(*(v.tolist() for v in np.nonzero(starts)), strict=True):
            i, a, b = some[r]
            k, e = int(y[r, c]) - 1, c + 1
            while e < b - a and y[r, e] == k + 1:
                e += 1
            if c < b - a:
                left = WINDOW if a == 0 else c
                right = WINDOW if b == len(codes[i]) else b - a - e
                found[i].append((a + c, a + e, k, min(left, right), at + r))
    return [[(a, b, KINDS[k]) for a, b, k in reconcile(f)] if f else [] for f in found]


def find_pii(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, start, length) of each span, in characters.

    A null or empty text gives no row; repeated rows give theirs again; other columns are ignored; an empty table gives an
    empty one. Map-only: the network reads every character of every text.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in pieces(batch):
                rows = [(i, *s) for i, spans in enumerate(tag(held.value, texts)) for s in spans]
                yield pa.record_batch([ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[3] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] - r[1] for r in rows], pa.int64())], ["id", "kind", "start", "length"])

    return per_document(docs, id_col, text_col, "kind string, start long, length long", f)


def mask_pii(docs: DataFrame, model: Tagger, text_col: str = "text") -> DataFrame:
    """docs with [kind] in place of each span in text_col. No row goes; null and clean texts stay as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(texts, tag(held.value, texts.tolist()), strict=True):
            for a, b, kind in reversed(spans):
                t = f"{t[:a]}[{kind}]{t[b:]}"
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`").cast("string")))


if __name__ == "__main__":
    save(fit(labelled(SAMPLES, SEED)))
