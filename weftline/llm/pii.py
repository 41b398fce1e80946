"""PII (6): rules for the base spans, and a character-level BiLSTM-CRF that adds spans.

The model is trained in numpy, from labelled spans: lines of a bounded sample of the corpus
(`sample_docs`, the first rows that arrive) into which entities of many spellings are written at known
places, along with look-alikes that are none. Besides the four kinds of the rules it knows `secret`, the
value that is assigned to a token, key or password. Its weights are kept in the shared folder under a hash of
what they were trained from. Gates are piecewise linear ("hard" sigmoid and tanh), so inference is a few
vector operations a character.

Every text is cut into overlapping windows; each window is decoded by Viterbi, and each character takes its
tag from the window whose middle is nearest, so spans run on across window ends. A window is decoded if it
or its overlap holds an anchor: a digit, an @, or an "at" in brackets or before a "dot". Every entity the
model is trained for has one, so other windows are outside. A window in which no path can beat "all outside"
skips the search; that bound is exact. A span is what the tags say, widened to whole runs of letters and
digits; no pattern decides about it. Spans that touch a base span are not added.

Characters beyond ASCII are one class. Defined results: null text counts as empty: no spans and the hash of
the empty string; texts of any length are read whole; repeated rows are each reported; an empty table gives
no rows (the model is then trained on generated words alone); other columns are ignored. Positions are code
points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common as C
from weftline.runtime import shared_dir, ship_package, table

KINDS = ("email", "ip", "card", "phone")
#: What the model tells apart; its own kind comes after those of the rules.
TAGGED = (*KINDS, "secret")
HIDDEN, WINDOW, OVERLAP = 32, 256, 64
F32 = np.float32
#: Changes with the labelled spans, so that kept weights follow them.
VERSION = 3

# ---- base rules

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i & 1:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def emails(t: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so that long runs of word characters cost no more than once."""
    end = 0
    at = t.find("@")
    while at >= 0:
        s = at
        while s > end and t[s - 1] in _LOCAL_SET:
            s -= 1
        m = _DOMAIN.match(t, at) if s < at else None
        if m:
            yield s, m.end()
            end = m.end()
            at = t.find("@", end)
        else:
            end = max(end, at + 1)
            at = t.find("@", at + 1)


def base_spans(t: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out = [(s, e, "email") for s, e in emails(t)]
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(t):
        d = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(t):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


# ---- labelled spans

_SINGLE = "@.+-()_%/:,=\"'| \n[]<>#"
#: Classes of characters: 0 pads, then each letter, each of some marks, digits by the length of their run (1 stands for them), and 2 for all others.
CLASS = np.full(256, 2, np.uint8)
CLASS[48:58] = 1
CLASS[97:123] = np.arange(3, 29)
CLASS[65:91] = np.arange(29, 55)
for _i, _c in enumerate(_SINGLE):
    CLASS[ord(_c)] = 55 + _i
DIGIT, LONGEST = 55 + len(_SINGLE), 20
N_CLASS = DIGIT + LONGEST


def classes(chars: np.ndarray, off: np.ndarray | None = None) -> np.ndarray:
    """The class of each character (lead byte); runs of digits don't cross the rows' bounds in `off`."""
    out = CLASS[chars]
    digit = out == 1
    st, en = C.runs(digit, np.array([0, len(chars)]) if off is None else off)
    out[digit] = np.repeat(DIGIT - 1 + np.minimum(en - st, LONGEST), en - st)
    return out


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _word(r: random.Random, lo: int = 2, hi: int = 9) -> str:
    return "".join(r.choice("etaoinshrdlucmfwypvbgkjqxz"[: r.choice((12, 26))]) for _ in range(r.randint(lo, hi)))


def _entity(r: random.Random, kind: str | None = None) -> tuple[str, str, str, str]:
    """(kind, what leads to it, the entity, what follows it)."""
    d, w = lambda n: _digits(r, n), lambda: _word(r)
    kind = kind or r.choices(TAGGED, (10, 6, 10, 18, 8))[0]  # the least regular ones more often
    if kind == "email":
        user = r.choice((w(), f"{w()}.{w()}", f"{w()}{d(2)}", f"{w()}.{d(2)}", f"{w()}_{w()}"))
        host = r.choice((w(), w(), f"{w()}{d(1)}.{w()}", f"{w()}-{w()}"))
        tld = r.choice(("com", "org", "net", "de", "fr", "es", "io", "co.uk"))
        at = r.choice(("@", "@", " @ ", " (at) ", " [at] ", "(at)", "[at]", " AT ", " at "))
        dot = {" AT ": " DOT ", " at ": " dot "}.get(at) or r.choice((".", ".", r.choice((" [dot] ", " (dot) ", "[dot]", "(dot)"))) if at != "@" else (".",))
        return kind, "", f"{user}{at}{host.replace('.', dot) if at != '@' else host}{dot}{tld}", ""
    if kind == "ip":
        return kind, "", r.choice((".", ".", ".", " . ", "[.]")).join(str(r.randint(0, 255)) for _ in range(4)), ""
    if kind == "card":
        g = [d(4) for _ in range(4)] if r.random() < 0.85 else [d(4), d(6), d(5)]
        return kind, "", r.choice(("", "", " ", "-")).join(g), ""
    if kind == "secret":
        value = "".join(r.choice(r.choice(("0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))) for _ in range(r.choice((16, 20, 24, 32, 40, 40, 64))))
        name = r.choice(("token", "token", "key", "api_key", "secret", "password", "passwd", "access_token", "auth token", "pwd"))
        s, q = r.choice((" = ", " = ", "=", ": ", ":", " : ")), r.choice(('"', '"', '"', "'", ""))
        if r.random() < 0.2:
            name, value = name.upper(), value.upper()
        return kind, name + s + q, value, q
    form = r.choice(("+1 ({}) {}-{}", "+1 ({}) {}-{}", "({}) {}-{}", "({}) {} {}", "{}-{}-{}", "{}.{}.{}", "{}.{}.{}", "+1-{}-{}-{}", "+49 {} {}{}", "+1 {} {} {}", "{} {} {}", "+1.{}.{}.{}"))
    if r.random() < 0.2:
        return kind, "", f"0{d(3)}{r.choice((' ', '/', '-', ' / '))}{d(r.randint(6, 8))}", ""
    return kind, "", form.format(d(3), d(3), d(4)), ""


def _alike(r: random.Random) -> str:
    d, w = lambda n: _digits(r, n), lambda: _word(r)
    return r.choice(
        (
            d(r.randint(1, 8)), f"{r.randint(1, 9)}.{r.randint(0, 9)}", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"20{d(2)}-0{d(1)}-{d(2)}", f"{d(2)}:{d(2)}", f"20{d(2)}-1{d(1)}-{d(2)}T{d(2)}:{d(2)}:{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"19{d(2)}-20{d(2)}",
            f"${d(3)}.{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}", "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 32, 40, 64)))), f"#{d(5)}", f"{d(1)},{d(3)},{d(3)}", f"@{d(2)}", f"@{w()}", f"({d(1)})", f"{d(4)}-{d(4)}", "+" + d(1), f"{d(3)}-{d(4)}", f"ISBN 978-{d(1)}-{d(3)}-{d(5)}-{d(1)}",
            f"{w()} at {w()}", f"at {d(2)} {w()}. {w()} dot", f"{w()} (at {d(2)})", f"the {r.choice(('token', 'key', 'secret', 'password'))} {w()} {w()}", f"{w()} = {w()}", f'{w()} = "{w()} {w()}"', f"{w()}: {w()}", f"{d(3)} {w()} {d(3)} {w()}", f"{d(2)} %", f"{d(1)}. {w()}", f"{w()}{d(3)}", f"v{d(1)}.{d(2)}", f"{d(3)} x {d(3)}", f"{d(10)} {w()}",
        )
    )


def labelled(lines: list[str], n: int, size: int = 72, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(classes, tags) of n windows of `size` characters: corpus lines with entities and look-alikes written in."""
    r = random.Random(seed)
    lines = lines or [" ".join(_word(r, 1) for _ in range(12)) for _ in range(200)]
    x, y = np.zeros((n, size), np.uint8), np.zeros((n, size), np.uint8)
    marks = ("", "", "", "", ".", ",", "!!", "$$$", "***", "###", "|", ";", ")")
    for i in range(n):
        text, tags = [], []

        def put(s: str, tag: int) -> None:
            text.append(s)
            tags.extend([tag] * len(s))

        while len(tags) < size + 40:
            line = r.choice(lines)
            a = r.randint(0, max(0, len(line) - 20))
            part = re.sub(r"[0-9@+]", "", line[a : a + r.randint(5, 50)])  # the line's own figures carry no labels
            put(part.rstrip() if r.random() < 0.9 else part.upper().rstrip(), 0)
            u = r.random()
            if u < 0.5:
                kind, lead, s, tail = _entity(r)
                put(r.choice((" ", " ", " ", "\n", " (", ": ", " | ", ". ")) + lead, 0)
                put(s, 1 + TAGGED.index(kind))
                put(tail + r.choice(marks) + r.choice((" ", " ", " ", "\n")), 0)
            elif u < 0.85:
                put(" " + _alike(r) + r.choice((" ", ". ", ", ", "\n")), 0)
        cut = r.randint(0, len(tags) - size)
        data = np.frombuffer("".join(text).encode("latin-1", "replace"), np.uint8)
        x[i] = classes(data)[cut : cut + size]
        y[i] = np.array(tags, np.uint8)[cut : cut + size]
    return x, y


# ---- the model

_K = 1 + len(TAGGED)
#: A path may enter a kind from outside, stay and leave; kinds never touch.
_ALLOWED = np.eye(_K, dtype=bool)
_ALLOWED[0, :] = _ALLOWED[:, 0] = True


def init(hidden: int = HIDDEN, seed: int = 1) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    p: dict[str, np.ndarray] = {}
    for d in "fb":
        p["W" + d] = (g.standard_normal((4 * hidden, N_CLASS)) * 0.3).astype(F32)
        p["U" + d] = (g.standard_normal((4 * hidden, hidden)) * (0.5 / np.sqrt(hidden))).astype(F32)
        p["W" + d][hidden : 2 * hidden] += 1.0  # forget gates begin open
    p["E"] = (g.standard_normal((_K, 2 * hidden)) * 0.3).astype(F32)
    p["e"] = np.array([1.0] + [-1.0] * (_K - 1), F32)
    p["T"] = np.where(np.eye(_K, dtype=bool), 1.0, -1.0).astype(F32)
    return p


def _lstm(w: np.ndarray, u: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hidden states (T, H, B) of classes x (T, B); gates are in, forget, out, cell."""
    t, b = x.shape
    h4, hid = u.shape
    h, c = np.zeros((hid, b), F32), np.zeros((hid, b), F32)
    out = np.empty((t, hid, b), F32)
    z, s = np.empty((h4, b), F32), np.empty((h4, b), F32)
    tmp = np.empty((hid, b), F32)
    for i in range(t):
        np.take(w, x[i], axis=1, out=z, mode="clip")
        np.matmul(u, h, out=s)
        z += s
        g = z[: 3 * hid]
        g *= F32(0.25)
        g += F32(0.5)
        np.minimum(g, F32(1), out=g)
        np.maximum(g, F32(0), out=g)
        q = z[3 * hid :]
        np.minimum(q, F32(1), out=q)
        np.maximum(q, F32(-1), out=q)
        c *= z[hid : 2 * hid]
        q *= z[:hid]
        c += q
        np.minimum(c, F32(1), out=tmp)
        np.maximum(tmp, F32(-1), out=tmp)
        h = out[i]
        np.multiply(z[2 * hid : 3 * hid], tmp, out=h)
    return out


def _both(w: np.ndarray, u: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (T, 2, H, B) of both directions at once, the second over reversed x (T, 2, B), and what its gradients need."""
    t, _, b = x.shape
    hid = u.shape[2]
    h, c = np.zeros((2, hid, b), w.dtype), np.zeros((2, hid, b), w.dtype)
    out, memo = np.empty((t, 2, hid, b), w.dtype), []
    for i in range(t):
        z = np.stack((w[0][:, x[i, 0]], w[1][:, x[i, 1]]))
        z += u @ h
        g = z[:, : 3 * hid]
        g *= 0.25
        g += 0.5
        np.clip(g, 0, 1, out=g)
        np.clip(z[:, 3 * hid :], -1, 1, out=z[:, 3 * hid :])
        cn = z[:, hid : 2 * hid] * c
        cn += z[:, :hid] * z[:, 3 * hid :]
        tc = np.clip(cn, -1, 1)
        memo.append((h, c, z, tc))
        h, c = z[:, 2 * hid : 3 * hid] * tc, cn
        out[i] = h
    return out, memo


def _both_back(w: np.ndarray, u: np.ndarray, x: np.ndarray, memo: list, dh_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t, _, b = x.shape
    hid = u.shape[2]
    du = np.zeros_like(u)
    dh, dc = np.zeros((2, hid, b), w.dtype), np.zeros((2, hid, b), w.dtype)
    every = np.empty((2, 4 * hid, t, b), w.dtype)
    ut = u.transpose(0, 2, 1).copy()
    for i in range(t - 1, -1, -1):
        h, c, a, tc = memo[i]
        dh += dh_out[i]
        dc += dh * a[:, 2 * hid : 3 * hid] * (np.abs(tc) < 1)
        dz = np.empty_like(a)
        np.multiply(dc, a[:, 3 * hid :], out=dz[:, :hid])
        np.multiply(dc, c, out=dz[:, hid : 2 * hid])
        np.multiply(dh, tc, out=dz[:, 2 * hid : 3 * hid])
        g = a[:, : 3 * hid]
        dz[:, : 3 * hid] *= 0.25 * ((g > 0) & (g < 1))
        np.multiply(dc * a[:, :hid], np.abs(a[:, 3 * hid :]) < 1, out=dz[:, 3 * hid :])
        every[:, :, i] = dz
        du += dz @ h.transpose(0, 2, 1)
        dh = ut @ dz
        dc *= a[:, hid : 2 * hid]
    dw = np.zeros_like(w)
    for k in range(2):
        flat, order = x[:, k].ravel(), np.argsort(x[:, k].ravel(), kind="stable")
        st = np.flatnonzero(np.concatenate(([True], np.diff(flat[order]) > 0)))
        dw[k][:, flat[order][st]] = np.add.reduceat(every[k].reshape(4 * hid, -1)[:, order], st, axis=1)
    return dw, du


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood a character of tags y under the CRF, for classes x, both (T, B)."""
    t, b = x.shape
    w, u = np.stack((p["Wf"], p["Wb"])), np.stack((p["Uf"], p["Ub"]))
    xx = np.stack((x, x[::-1]), axis=1)
    hs, memo = _both(w, u, xx)
    hh = np.concatenate((hs[:, 0], hs[::-1, 1]), axis=1)
    em = np.matmul(p["E"], hh) + p["e"][None, :, None]
    tr = np.where(_ALLOWED, p["T"], F32(-30))
    al = np.empty_like(em)
    al[0] = em[0]
    for i in range(1, t):
        al[i] = em[i] + _lse(al[i - 1][:, None, :] + tr[:, :, None], 0)
    be = np.zeros_like(em)
    for i in range(t - 2, -1, -1):
        be[i] = _lse(tr[:, :, None] + (em[i + 1] + be[i + 1])[None], 1)
    z = _lse(al[-1], 0)
    marg = np.exp(al + be - z)
    gold = np.zeros_like(em)
    np.put_along_axis(gold, y[:, None, :].astype(np.int64), 1, axis=1)
    score = (em * gold).sum() + tr[y[:-1], y[1:]].sum()
    scale = F32(1 / (t * b))
    dem = (marg - gold) * scale
    dtr = np.zeros((_K, _K), np.float64)
    for i in range(t - 1):
        dtr += np.exp(al[i][:, None, :] + tr[:, :, None] + (em[i + 1] + be[i + 1])[None] - z).sum(-1)
    np.subtract.at(dtr, (y[:-1].ravel(), y[1:].ravel()), 1)
    g = {"T": (dtr * _ALLOWED).astype(F32) * scale, "E": np.einsum("tkb,thb->kh", dem, hh, optimize=True), "e": dem.sum((0, 2))}
    dh = np.matmul(p["E"].T, dem).astype(w.dtype)
    hid = p["Uf"].shape[1]
    dw, du = _both_back(w, u, xx, memo, np.stack((dh[:, :hid], dh[::-1, hid:]), axis=1))
    for k, d in enumerate("fb"):
        g["W" + d], g["U" + d] = dw[k], du[k]
    return float((z.sum() - score) * scale), g


def train(x: np.ndarray, y: np.ndarray, steps: int = 420, batch: int = 64, rate: float = 0.02, hidden: int = HIDDEN, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights after `steps` Adam steps over windows x with tags y, both (n, size)."""
    p, r = init(hidden, seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    for i in range(1, steps + 1):
        at = r.integers(0, len(x), batch)
        _, g = loss_and_gradients(p, x[at].T.astype(np.int64), y[at].T.astype(np.int64))
        norm = np.sqrt(sum(float((w**2).sum()) for w in g.values()))
        lr = rate * min(1, i / 20) * (1 if i < 0.7 * steps else 0.25)
        for k in p:
            w = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * w
            v[k] = 0.99 * v[k] + 0.01 * w * w
            p[k] = (p[k] - lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)).astype(F32)
    return p


def decode(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Best tags (T, B) of classes x (T, B); 0 pads are outside."""
    t, b = x.shape
    x = x.astype(np.intp)
    hf = _lstm(p["Wf"], p["Uf"], x)
    hb = _lstm(p["Wb"], p["Ub"], x[::-1])
    hid = hf.shape[1]
    tr = p["T"]
    # only differences to "outside" matter, and so do those of transitions
    d = (p["E"][1:] - p["E"][:1]).astype(F32)
    e = np.matmul(d[:, :hid], hf)
    e += np.matmul(d[:, hid:], hb[::-1])
    e += (p["e"][1:] - p["e"][0] - tr[0, 0])[None, :, None]
    tags = np.zeros((t, b), np.uint8)
    stay = np.array([tr[k, k] for k in range(1, _K)], F32)
    enter, leave = tr[0, 1:].astype(F32), tr[1:, 0].astype(F32)
    # the most that any stretch inside kinds can win over staying outside
    step = np.maximum(np.maximum(stay, enter), tr[0, 0]) + np.maximum(leave - tr[0, 0], 0)
    gain = np.maximum(e + step[None, :, None], 0).max(1).sum(0)
    todo = np.flatnonzero(gain > 0)
    if not len(todo):
        return tags
    e = e[:, :, todo]
    n = len(todo)
    o, s = np.zeros(n, F32), e[0] + tr[0, 0]  # nothing comes before the first
    from_o = np.zeros((t, _K - 1, n), bool)
    to_o = np.zeros((t, n), np.uint8)
    lo, st, en, z = leave[:, None], stay[:, None], enter[:, None], tr[0, 0]
    for i in range(1, t):
        out = s + (lo - z)
        k = out.argmax(0)
        best = out[k, np.arange(n)]
        win = best > o
        to_o[i] = np.where(win, k + 1, 0)
        a, c = s + st, o[None] + en
        from_o[i] = c > a
        s = np.maximum(a, c) + e[i]
        o = np.where(win, best, o)
    state = np.where(s.max(0) > o, s.argmax(0) + 1, 0)
    cols = np.arange(n)
    res = np.zeros((t, n), np.uint8)
    for i in range(t - 1, -1, -1):
        res[i] = state
        if i:
            inside = state > 0
            state = np.where(inside, np.where(from_o[i][np.maximum(state - 1, 0), cols], 0, state), to_o[i])
    tags[:, todo] = res
    return tags


def anchors(cls: np.ndarray) -> np.ndarray:
    """Characters that every entity has one of: a digit, an @, the "a" of an "at" in brackets or before a "dot"."""
    out = (cls >= DIGIT) | (cls == CLASS[64])
    letter = (cls >= 3) & (cls < 55)
    fold = np.where(cls >= 29, cls - 26, cls)
    n = len(cls)

    def words(w: str) -> np.ndarray:
        k = len(w)
        if n < k + 2:
            return np.zeros(0, np.int64)
        hit = letter[1 : n - k]
        for j, ch in enumerate(w):
            hit = hit & (fold[1 + j : n - k + j] == CLASS[ord(ch)]) & letter[1 + j : n - k + j]
        return np.flatnonzero(hit & ~letter[: n - k - 1] & ~letter[k + 1 : n]) + 1

    at, dot = words("at"), words("dot")
    open_ = np.zeros(256, bool)
    open_[[CLASS[40], CLASS[91]]] = True
    far = np.append(dot, n + 1000)[np.searchsorted(dot, at)] - at
    out[at[open_[cls[at - 1]] | (far < OVERLAP)]] = True
    return out


def tag(p: dict[str, np.ndarray], cls: np.ndarray, off: np.ndarray, window: int = WINDOW, overlap: int = OVERLAP, batch: int = 1024) -> np.ndarray:
    """A tag for every character of a slice; cls are classes, off the rows' bounds in characters."""
    lens = np.diff(off)
    stride = window - overlap
    n = np.where(lens > 0, 1 + np.maximum(0, -(-(lens - window) // stride)), 0)
    row = np.repeat(np.arange(len(lens)), n)
    k = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    start = off[row] + k * stride
    out = np.zeros(len(cls), np.uint8)
    if not len(row):
        return out
    end = np.minimum(start + window, off[row + 1])
    # a window owns its middle; the outermost windows own the text's ends
    own_lo = np.where(k == 0, start, start + overlap // 2)
    own_hi = np.where(k == n[row] - 1, end, start + window - (overlap - overlap // 2))
    c = np.concatenate(([0], np.cumsum(anchors(cls))))
    some = c[np.minimum(end + overlap, off[row + 1])] > c[np.maximum(start - overlap, off[row])]
    start, end, own_lo, own_hi = start[some], end[some], own_lo[some], own_hi[some]
    padded = np.concatenate((cls, np.zeros(window, np.uint8)))
    steps = np.arange(window)
    size = end - start
    order = np.argsort(size, kind="stable")  # short texts together, in short batches
    for lo in range(0, len(order), batch):
        w = order[lo : lo + batch]
        t = int(size[w].max())
        at = start[w][None, :] + steps[:t, None]
        x = padded[at]
        x[at >= end[w][None, :]] = 0
        tags = decode(p, x)
        if tags.any():
            i, j = np.nonzero(tags)
            pos = at[i, j]
            ok = (pos >= own_lo[w][j]) & (pos < own_hi[w][j])
            out[pos[ok]] = tags[i, j][ok]
    return out


# ---- spans of documents

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ALNUM = _DIGIT.copy()
_ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True


def _added(tags: np.ndarray, off: np.ndarray, chars: np.ndarray, base: dict[int, list]) -> dict[int, list]:
    """The model's spans by row, clear of the base spans: runs of one tag, widened to whole runs of letters and digits."""
    out: dict[int, list] = {}
    change = np.concatenate(([True], tags[1:] != tags[:-1]))
    change[off[:-1][off[:-1] < len(tags)]] = True
    st = np.flatnonzero(change)
    en = np.append(st[1:], len(tags))
    ok = tags[st] > 0
    for s, e in zip(st[ok].tolist(), en[ok].tolist()):
        kind = TAGGED[tags[s] - 1]
        r = int(np.searchsorted(off, s, side="right")) - 1
        lo, hi = int(off[r]), int(off[r + 1])
        while s < e and not _ALNUM[chars[s]] and chars[s] not in b"+(":
            s += 1
        while e > s and not _ALNUM[chars[e - 1]]:
            e -= 1
        if s == e:
            continue
        while s > lo and _ALNUM[chars[s]] and _ALNUM[chars[s - 1]]:
            s -= 1
        while e < hi and _ALNUM[chars[e]] and _ALNUM[chars[e - 1]]:
            e += 1
        s, e = s - lo, e - lo
        own = out.setdefault(r, [])
        if own and s < own[-1][1]:  # widened into the span before
            if own[-1][2] == kind:
                own[-1] = (own[-1][0], max(e, own[-1][1]), kind)
            continue
        own.append((s, e, kind))
    for r, found in list(out.items()):
        left = [x for x in found if all(x[1] <= a or x[0] >= b for a, b, _ in base.get(r, ()))]
        if left:
            out[r] = left
        else:
            del out[r]
    return out


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], TAGGED.index(x[2]), x[1])))


def _find(p: dict[str, np.ndarray]):
    nothing = hashlib.sha256(b"").hexdigest()
    marks = np.zeros(256, bool)
    marks[[64, 43]] = True
    marks |= _DIGIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in C.slices(batches):
            n = rows.num_rows
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            chars = data[lead]
            coff = np.searchsorted(lead, off)
            c = np.concatenate(([0], np.cumsum(marks[data])))
            some = np.flatnonzero(c[off[1:]] > c[off[:-1]])  # every base span has one of them
            base: dict[int, list] = {}
            for r, t in zip(some.tolist(), C.column(rows, "text").take(pa.array(some)).to_pylist()):
                if found := base_spans(t):
                    base[r] = found
            more = _added(tag(p, classes(chars, coff), coff), coff, chars, base) if len(chars) else {}
            count = np.zeros((4, n), np.int64)
            sha, spans = [nothing] * n, [""] * n
            for r, found in base.items():
                for _, _, k in found:
                    count[KINDS.index(k), r] += 1
                spans[r] = s = _join(found)
                sha[r] = hashlib.sha256(s.encode()).hexdigest()
            added = np.zeros(n, np.int64)
            for r, found in more.items():
                spans[r] = _join(base.get(r, []) + found)
                added[r] = len(found)
            yield pa.RecordBatch.from_arrays(
                [C.column(rows, "doc_id"), *(pa.array(x) for x in count), pa.array(sha), pa.array(spans), pa.array(added), pa.array(count.sum(0) + added)],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"],
            )

    return run


_models: dict[str, dict[str, np.ndarray]] = {}


def learn(docs: DataFrame, sample_docs: int = 200, windows: int = 6000, steps: int = 420) -> dict[str, np.ndarray]:
    """A model for this corpus, trained on labelled windows over lines of at most sample_docs documents.

    Weights are kept in the shared folder under a hash of the lines and settings, so a corpus is learnt once.
    """
    spark = docs.sparkSession
    lines = sorted(x for r in docs.select(F.col("text").cast("string")).limit(sample_docs).collect() for x in (r[0] or "").split("\n") if len(x) > 20)
    key = hashlib.sha256(repr((lines, windows, steps, HIDDEN, N_CLASS, VERSION)).encode()).hexdigest()
    if key not in _models:
        path = f"{shared_dir(spark)}/weftline-models/pii-{key}.parquet"
        try:
            row = spark.read.parquet(path).first()
            _models[key] = {n: np.frombuffer(w, F32).reshape(shape).copy() for n, w, shape in row["weights"]}
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            m = _models[key] = train(*labelled(lines, windows), steps=steps)
            one = [([(n, bytearray(w.astype(F32).tobytes()), list(w.shape)) for n, w in m.items()],)]
            spark.createDataFrame(one, "weights array<struct<name:string,w:binary,shape:array<int>>>").coalesce(1).write.mode("overwrite").parquet(path)
    return _models[key]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def find_pii(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Base counts and hash, and all spans, of every document."""
    ship_package(docs.sparkSession)
    model = model or learn(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_find(model), SCHEMA)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many base spans op6_pii counts, for comparison with SQL; their places are compared in tests."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


_DIGITS_SQL = "list_reverse(regexp_extract_all(m, '[0-9]'))"
PII_BASE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS n_email,
 len(list_filter(regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda m: len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (CASE WHEN length(ltrim(x, '0')) BETWEEN 1 AND 3 THEN ltrim(x, '0')::INT ELSE 0 END) > 255)) = 0)) AS n_ip,
 len(list_filter(regexp_extract_all(t, '[0-9]([\\x20-]?[0-9])+'), lambda m: len({_DIGITS_SQL}) BETWEEN 12 AND 19
  AND list_sum(list_transform({_DIGITS_SQL}, lambda x, i: CASE WHEN i % 2 = 0 THEN 2 * x::INT - CASE WHEN x::INT > 4 THEN 9 ELSE 0 END ELSE x::INT END)) % 10 = 0)) AS n_card,
 len(list_filter(regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda m: len({_DIGITS_SQL}) BETWEEN 9 AND 15)) AS n_phone FROM t
"""
