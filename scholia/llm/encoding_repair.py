"""Text decoded with the wrong character encoding: found and restored by a hidden Markov model.

One state is clean, each other state is a pair (the text's own encoding, the one it was read with),
once or twice over. A state emits what its inverse transform makes of the characters, by a character
bigram model that is trained on the corpus itself. Viterbi labels every character; each labelled
span gets its state's inverse. Texts are read a batch at a time: what a single-byte confusion costs
depends on two neighbouring characters only, so it is computed once a distinct pair of the batch; a
text in which no state beats the clean one anywhere is done without a search; the others of similar
length are searched together, as one matrix of texts and states.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.session import read_shared, scratch_path, spread

#: Single-byte encodings that UTF-8 is read with by mistake.
READ_AS = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "mac-roman", "cp437", "cp850", "koi8-r", "iso8859-2")
#: Twice over: what UTF-8 was read with, both times.
TWICE = (("latin-1", "latin-1"), ("cp1252", "cp1252"), ("latin-1", "cp1252"), ("cp1252", "latin-1"), ("cp1250", "cp1250"), ("mac-roman", "mac-roman"))
#: Single-byte encodings read as another one: (own, read as).
CONFUSED = (
    ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp1253", "cp1252"), ("cp1250", "cp1252"), ("cp1254", "cp1252"), ("iso8859-2", "cp1252"),
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "mac-roman"), ("cp1253", "mac-roman"),
    ("cp1252", "mac-roman"), ("mac-roman", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1250"),
)
#: Nats: entering a state and leaving it again; a character lost in decoding, read in a damaged state.
ENTER, LEAVE, LOST = 7.0, 2.0, 4.0
#: The same for a single-byte encoding taken for another: any sign has a reading there, so more evidence is asked.
ENTER_CONFUSED = 22.0
#: What one character can say for such a state at most: a few rare signs in a row are no text of another encoding.
MOST_CONFUSED = 3.0
#: An escape from clean text to unrestorable text (its replacement characters), and its cost a character.
DAMAGED = "damaged"
_BARRIER = -1
#: Cells (texts x states x steps) of one search, and characters of texts that are read together, about.
SEARCH_CELLS, BATCH_CHARS = 1 << 21, 1 << 20
#: Lies between two texts in a running sum: more than a text can gain.
_APART = 1e7
_REPLACEMENT = 0xFFFD
TOP = 0x110000


@lru_cache(maxsize=32)
def _to_byte(encoding: str) -> np.ndarray:
    """Code point -> byte in a single-byte encoding, -1 where there's none; undefined bytes stay C1 controls."""
    out = np.full(TOP, -1, np.int16)
    out[:256] = np.where(np.arange(256) < 128, np.arange(256), -1)
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            out[b] = b
    return out


@lru_cache(maxsize=32)
def _from_byte(encoding: str) -> np.ndarray:
    out = np.arange(256, dtype=np.int64)
    for b in range(128, 256):
        try:
            out[b] = ord(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out[b] = _BARRIER
    return out


@dataclass
class Units:
    """A reading of a text: code points (or a barrier), each with the span of characters it stands for."""

    code: np.ndarray
    start: np.ndarray
    length: np.ndarray


def _as_utf8(u: Units, encoding: str) -> tuple[Units, bool]:
    """What the units are if UTF-8 bytes were read with ``encoding``; False if nothing but ASCII decodes."""
    high = u.code >= 128
    if not high.any():
        return u, False
    b = np.where(u.code >= 0, _to_byte(encoding)[np.maximum(u.code, 0)], -1).astype(np.int64)
    n = len(b)
    pad = np.concatenate([b, [-1, -1, -1]])
    cont = (pad >= 0x80) & (pad < 0xC0)
    c1, c2, c3 = cont[1 : n + 1], cont[2 : n + 2], cont[3 : n + 3]
    two = (b >= 0xC2) & (b < 0xE0) & c1
    three = (b >= 0xE0) & (b < 0xF0) & c1 & c2
    four = (b >= 0xF0) & (b < 0xF5) & c1 & c2 & c3
    if not (two.any() or three.any() or four.any()):
        return u, False
    b1, b2, b3 = pad[1 : n + 1], pad[2 : n + 2], pad[3 : n + 3]
    code = np.where(high | (u.code < 0), _BARRIER, u.code)
    code = np.where(two, ((b & 0x1F) << 6) | (b1 & 0x3F), code)
    code = np.where(three, ((b & 0x0F) << 12) | ((b1 & 0x3F) << 6) | (b2 & 0x3F), code)
    code = np.where(four, ((b & 0x07) << 18) | ((b1 & 0x3F) << 12) | ((b2 & 0x3F) << 6) | (b3 & 0x3F), code)
    bad = (three & ((code < 0x800) | ((code >= 0xD800) & (code < 0xE000)))) | (four & ((code < 0x10000) | (code >= TOP)))
    code = np.where(bad, _BARRIER, code)
    three, four = three & ~bad, four & ~bad
    width = np.where(two, 2, np.where(three, 3, np.where(four, 4, 1)))
    covered = np.zeros(n + 4, bool)
    for k in (1, 2, 3):
        covered[k : n + k] |= width > k
    first = ~covered[:n]
    at = np.flatnonzero(first)
    ends = u.start + u.length
    last = np.minimum(at + width[at] - 1, n - 1)
    return Units(code[at], u.start[at], ends[last] - u.start[at]), bool((two | three | four).any())


_CUTS = re.compile("[^\x00-\x7f�。、，；：！？]+�*")


def _as_multibyte(text: str, x: np.ndarray, encoding: str) -> tuple[list[tuple[int, int, str]], bool]:
    """Runs of non-ASCII characters that make UTF-8 when written in a multi-byte encoding: (start, end, text)."""
    runs = []
    for m in _CUTS.finditer(text):
        if m.end() - m.start() < 3:
            continue
        run = m.group().rstrip("�")
        try:
            data = run.encode(encoding)
        except UnicodeEncodeError:
            continue
        made = data.decode("utf-8", "replace")
        if 2 * made.count("�") < len(made) - 1:
            runs.append((m.start(), m.end(), made))
    return runs, bool(runs)


class Bigrams:
    """-log P(character | the one before), shrunk towards single characters; trained by `train`."""

    def __init__(self, single: dict[int, int], pairs_key: np.ndarray, pairs_n: np.ndarray) -> None:
        total = max(1, sum(single.values()))
        self.strength = 1e-4 * total + 20
        self.p1 = np.full(TOP + 1, 0.05 / (total + 1000), np.float64)
        self.n1 = np.zeros(TOP + 1, np.float64)
        for c, n in single.items():
            self.p1[c] += n / (total + 1000)
            self.n1[c] = n
        order = np.argsort(pairs_key)
        self.keys, self.counts = pairs_key[order], pairs_n[order].astype(np.float64)

    def cost(self, code: np.ndarray, before: np.ndarray) -> np.ndarray:
        c, p = np.where(code < 0, TOP, code), np.where(before < 0, TOP, before)
        key = (p.astype(np.int64) << 21) | c
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        n = np.where(self.keys[at] == key, self.counts[at], 0.0) if len(self.keys) else np.zeros(len(key))
        return -np.log((n + self.strength * self.p1[c]) / (self.n1[p] + self.strength))


@lru_cache(maxsize=1)
def states() -> tuple[tuple[str, ...], ...]:
    utf = [("utf-8", w) for w in READ_AS]
    double = [("utf-8", a, "utf-8", b) for a, b in TWICE]
    return (*utf, *double, *CONFUSED, ("utf-8", "gb18030"), ("utf-8", "cp932"), ("utf-8", "big5"), (DAMAGED,))


class Decoder:
    def __init__(self, model: Bigrams) -> None:
        self.model = model

    def readings(self, text: str, x: np.ndarray, possible):
        """(state, emission a character or None, units or runs) of every ``possible`` state that could explain something."""
        n = len(x)
        plain = Units(x, np.arange(n), np.ones(n, np.int64))
        m = self.model
        for s in possible:
            if s[0] == DAMAGED:
                lost = x == _REPLACEMENT
                if lost.any():
                    cost = m.cost(x, np.concatenate([[10], x[:-1]]))
                    near = np.concatenate([[False], lost[:-1]])
                    yield s, np.where(lost | near, LOST, cost + 0.02), None
            elif s[1] in ("gb18030", "cp932", "big5"):
                runs, ok = _as_multibyte(text, x, s[1]) if (x >= 0x3000).any() else ([], False)
                if ok:
                    yield s, None, runs
            elif len(s) == 4:
                u, ok = _as_utf8(plain, s[3])
                if ok:
                    u, ok = _as_utf8(u, s[1])
                if ok:
                    yield s, None, u
            elif s[0] == "utf-8":
                u, ok = _as_utf8(plain, s[1])
                if ok:
                    yield s, None, u
            else:
                b = _to_byte(s[1])[x]
                code = np.where(b >= 0, _from_byte(s[0])[np.maximum(b, 0)], _BARRIER)
                if ((code != x) & (code >= 0)).any():
                    yield s, None, Units(code, plain.start, plain.length)

    def possible(self, texts: list[str]) -> list[list[tuple[str, ...]]]:
        """The states of each text that may beat the clean one, found for all texts together."""
        joined, begin = _joined(texts)
        out: list[list[tuple[str, ...]]] = [[] for _ in texts]
        at = np.flatnonzero(joined >= 128)
        if not len(at):
            return out
        x = joined[at]
        owner = np.searchsorted(begin, at, "right") - 1
        follows = np.concatenate([np.diff(at) == 1, [False]])  # whether the next sign is the next character
        seen = {w: np.unique(owner[n > 0]) for w, n in ((w, _sequences(x, follows, w)) for w in READ_AS)}
        wide, lost = np.unique(owner[x >= 0x3000]), np.unique(owner[x == _REPLACEMENT])
        gains = self._confusions(joined, begin, at)
        for s in states():
            if s[0] == DAMAGED:
                hit = lost
            elif s in CONFUSED:
                hit = gains.get(s, ())
            else:
                hit = seen[s[-1]] if s[-1] in seen else wide
            for k in hit:
                out[k].append(s)
        return out

    def _confusions(self, joined: np.ndarray, begin: np.ndarray, at: np.ndarray) -> dict[tuple[str, ...], np.ndarray]:
        """The texts in which a span read as a single-byte confusion gains more than its toll.

        Two ASCII characters cost the same in every state, so only places at or behind another sign count.
        """
        place = np.union1d(at, np.minimum(at + 1, len(joined) - 1))
        place = place[joined[place - 1] + joined[place] >= 128]  # every text has a line end before it
        pair, which = np.unique((joined[place - 1] << 21) | joined[place], return_inverse=True)
        before, sign = pair >> 21, pair & 0x1FFFFF
        clean = self.model.cost(sign, before)
        owner = np.searchsorted(begin, place, "right") - 1
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        held = owner[first]
        apart = np.zeros(len(place))
        apart[first] = -_APART
        out = {}
        for s in CONFUSED:
            gain = np.maximum(clean - self._confused(s, before, sign, clean), -1e4)
            if not (gain > 0).any():
                continue
            total = np.cumsum(gain[which] + apart)
            # A span may begin with the first place of a text: the sum before it is the lowest so far.
            low = np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]) + apart)
            best = np.maximum.reduceat(total - low, first)
            out[s] = held[best > ENTER_CONFUSED]
        return out

    def _confused(self, s: tuple[str, ...], before: np.ndarray, sign: np.ndarray, clean: np.ndarray) -> np.ndarray:
        """What a character costs after another one in the state of a single-byte confusion."""
        table, back = _to_byte(s[1]), _from_byte(s[0])
        read = lambda c: np.where(table[c] >= 0, back[np.maximum(table[c], 0)], _BARRIER)
        code, prior = read(sign), read(before)
        cost = self.model.cost(code, prior)
        after = prior < 0
        cost[after] = np.where(code[after] != sign[after], -np.log(self.model.p1[code[after]]), clean[after])
        cost[code < 0] = np.inf
        return np.maximum(cost, clean - MOST_CONFUSED)

    def label(self, text: str):
        """The list of (start, end, state) spans that aren't clean, best path over all states."""
        return self.label_all([text])[0]

    def label_all(self, texts: list[str]) -> list[list[tuple[int, int, tuple[str, ...]]]]:
        """`label` of every text."""
        lattices, out = [], [[] for _ in texts]
        for k, possible in enumerate(self.possible(texts)):
            if possible and (made := self._lattice(texts[k], possible)):
                lattices.append((k, *made))
        for k, spans in _viterbi(lattices):
            out[k] = spans
        return out

    def _lattice(self, text: str, possible):
        """(states, emissions, may start, may end) of the states that gain more than their toll somewhere, or None."""
        x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = len(x)
        clean = self.model.cost(x, np.concatenate([[10], x[:-1]]))
        names, emit, start, end = [None], [clean], [np.ones(n, bool)], [np.ones(n, bool)]
        for s, cost, reading in self.readings(text, x, possible):
            can_start, can_end = np.ones(n, bool), np.ones(n, bool)
            if cost is None and isinstance(reading, Units):
                u = reading
                per = self.model.cost(u.code, np.concatenate([[10], u.code[:-1]]))
                per[u.code < 0] = np.inf
                after_barrier = np.concatenate([[False], u.code[:-1] < 0]) & (u.code >= 0)
                per[after_barrier] = clean[u.start[after_barrier]]
                decoded = (u.length > 1) | (u.code != x[u.start])
                per[after_barrier & decoded] = -np.log(self.model.p1[u.code[after_barrier & decoded]]) if (after_barrier & decoded).any() else 0
                cost = np.zeros(n)
                cost[u.start] = per
                can_start[:] = False
                can_start[u.start] = True
                can_end[:] = False
                can_end[u.start + u.length - 1] = True
            elif cost is None:
                cost = np.where(x < 128, clean, np.inf)
                can_start, can_end = x < 128, x < 128
                for a, b, made in reading:
                    d = np.array([ord(c) for c in made], np.int64)
                    each = np.minimum(self.model.cost(d, np.concatenate([[10], d[:-1]])), np.where(d == _REPLACEMENT, LOST, np.inf))
                    cost[a:b] = each.sum() / (b - a)
                    can_start[a], can_end[b - 1] = True, True
            if s in CONFUSED:
                cost = np.maximum(cost, clean - MOST_CONFUSED)
            # Gains anywhere? Cumulated, so that a span's gain counts, not one character's.
            total = np.concatenate([[0.0], np.cumsum(np.where(np.isfinite(cost), clean - cost, -1e4))])
            best = float((total - np.minimum.accumulate(total)).max())
            if best > (ENTER_CONFUSED if s in CONFUSED else ENTER):
                names.append(s), emit.append(cost), start.append(can_start), end.append(can_end)
        return None if len(names) == 1 else (names, np.array(emit), np.array(start), np.array(end))

    def restore(self, text: str, spans) -> tuple[str, bool]:
        """(text with every span inverted, whether nothing was lost)."""
        out, done, whole = [], 0, True
        for a, b, s in spans:
            out.append(text[done:a])
            part = text[a:b]
            done = b
            if s[0] == DAMAGED:
                out.append(part)
                whole = False
            else:
                made, sound = _invert(part, s)
                whole &= sound and "�" not in made
                out.append(made)
        out.append(text[done:])
        return "".join(out), whole


def _viterbi(lattices):
    """(key, spans) of every (key, states, emissions, may start, may end); those of similar length are one matrix."""
    packed = []
    for key, names, emit, start, end in lattices:
        # Characters between which every state costs the same are one step.
        spread = np.where(np.isfinite(emit), emit, 1e6)
        same = (spread.max(axis=0) - spread.min(axis=0) < 1e-9) & start.all(axis=0) & end.all(axis=0)
        keep = ~same | np.concatenate([[True], ~same[:-1]])
        at = np.flatnonzero(keep)
        packed.append((len(at), key, names, emit[:, at], start[:, at], end[:, at], np.cumsum(keep) - 1))
    packed.sort(key=lambda p: p[0])
    group, states_ = [], 0
    for p in packed:
        states_ = max(states_, len(p[2]))
        if group and (len(group) + 1) * states_ * (p[0] + 1) > SEARCH_CELLS:
            yield from _search(group)
            group, states_ = [], len(p[2])
        group.append(p)
    if group:
        yield from _search(group)


def _search(group):
    """The best paths of some texts; a text's steps are followed by clean ones, which end its last span."""
    n, k, steps = len(group), max(len(p[2]) for p in group), max(p[0] for p in group) + 1
    emit = np.full((steps, n, k), np.inf)
    emit[:, :, 0] = 0.0
    enter, may_end = np.full((steps, n, k), np.inf), np.ones((steps, n, k), bool)
    enter[:, :, 0] = 0.0
    for i, (size, _, names, e, start, end, _) in enumerate(group):
        toll = np.array([0.0] + [ENTER_CONFUSED if s in CONFUSED else ENTER for s in names[1:]])
        emit[:size, i, : len(names)] = e.T
        enter[:size, i, : len(names)] = np.where(start.T, toll, np.inf)
        may_end[:size, i, : len(names)] = end.T
    score = np.full((n, k), np.inf)
    score[:, 0] = 0.0
    pay = np.where(np.arange(k) > 0, LEAVE, 0.0)
    stays, sources = np.empty((steps, n, k), bool), np.empty((steps, n), np.int16)
    row = np.arange(n)
    leave = score + pay
    for j in range(steps):
        source = leave.argmin(axis=1)
        entered = leave[row, source][:, None] + enter[j]
        stay = score <= entered
        stays[j], sources[j] = stay, source
        score = np.where(stay, score, entered) + emit[j]
        leave = np.where(may_end[j], score + pay, np.inf)
    state = np.zeros(n, np.int64)  # the step behind a text is clean
    path = np.empty((steps, n), np.int16)
    for j in range(steps - 1, -1, -1):
        path[j] = state
        state = np.where(stays[j, row, state], state, sources[j])
    for i, (size, key, names, _, _, _, step) in enumerate(group):
        full = path[:size, i][step]
        edges = [0, *(np.flatnonzero(np.diff(full)) + 1).tolist(), len(full)]
        yield key, [(a, b, names[full[a]]) for a, b in zip(edges[:-1], edges[1:], strict=True) if full[a]]


def _invert(part: str, s: tuple[str, ...]) -> tuple[str, bool]:
    """(what a span was before, whether every sign of it had a place in the encoding it was read with)."""
    sound = True
    for own, read in [(s[k], s[k + 1]) for k in range(len(s) - 2, -1, -2)]:
        if read in ("gb18030", "cp932", "big5"):
            pieces, at = [], 0
            for m in _CUTS.finditer(part):
                pieces += [part[at : m.start()], m.group().rstrip("�").encode(read, "replace").decode(own, "replace")]
                at = m.end()
            part = "".join([*pieces, part[at:]])
        else:
            data = _to_byte(read)[[ord(c) for c in part]]
            sound &= bool((data >= 0).all())
            part = np.where(data < 0, 0x3F, data).astype(np.uint8).tobytes().decode(own, "replace")
    return part, sound


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, a line end before each, and where each text's line end is."""
    joined = np.frombuffer("".join("\n" + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
    return joined, begin


def _sequences(x: np.ndarray, follows: np.ndarray, encoding: str) -> np.ndarray:
    """1 for every sign of x that begins what reads as a UTF-8 sequence in ``encoding``; x are signs outside ASCII."""
    b = _to_byte(encoding)[x]
    tail = (b >= 0x80) & (b < 0xC0)
    next_ = lambda v: np.concatenate([v[1:], [False]]) & follows
    one = next_(tail)
    two = one & next_(one)
    three = one & next_(two)
    return (((b >= 0xC2) & (b < 0xE0) & one) | ((b >= 0xE0) & (b < 0xF0) & two) | ((b >= 0xF0) & (b < 0xF5) & three)).astype(np.int64)


_FAST = re.compile("[�\x80-\x9f-]")


def _plausible(texts: list[str]) -> np.ndarray:
    """Whether texts may train the first model: at most one thing in each decodes as UTF-8, no sign is lost or private."""
    joined, begin = _joined(texts)
    at = np.flatnonzero(joined >= 128)
    owner = np.searchsorted(begin, at, "right") - 1
    follows = np.concatenate([np.diff(at) == 1, [False]]) if len(at) else np.empty(0, bool)
    good = np.array([not _FAST.search(t) for t in texts], bool)
    for w in ("latin-1", "cp1252", "cp1250", "cp1251", "mac-roman", "cp437"):
        found = np.bincount(owner, _sequences(joined[at], follows, w), len(texts)) if len(at) else np.zeros(len(texts))
        good &= found <= 1
    return good


def _runs(items, length=len, size: int = BATCH_CHARS):
    """The items in runs of about ``size`` characters."""
    run, held = [], 0
    for t in items:
        run.append(t)
        held += length(t)
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def _count(decoder_path: str | None):
    """Single characters and pairs of neighbours of the texts held clean, a row each: (pair or -1, char, n)."""

    def count(batches):
        total: dict[int, int] = {}
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            arrays = []
            for run in _runs(texts):
                if decoder_path is None:
                    held = _plausible(run)
                else:
                    held = [not spans for spans in Decoder(load_model(decoder_path)).label_all(run)]
                arrays += [np.frombuffer(("\n" + t).encode("utf-32-le", "surrogatepass"), np.uint32) for t, ok in zip(run, held, strict=True) if ok]
            if not arrays:
                continue
            x = np.concatenate(arrays).astype(np.int64)
            keys = np.concatenate([x, ((x[:-1] + 1) << 21) | x[1:]])
            # Pairs of ideographs are left to their single characters: their pairs say little and are too many.
            pair = keys >= 1 << 21
            wide = pair & (((keys >> 21) - 1 >= 0x3100) | ((keys & 0x1FFFFF) >= 0x3100))
            for key, n in zip(*(v.tolist() for v in np.unique(keys[~wide], return_counts=True)), strict=True):
                total[key] = total.get(key, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int64()), pa.array(list(total.values()), pa.int64())], ["key", "n"])

    return count


@lru_cache(maxsize=2)
def load_model(path: str) -> Bigrams:
    tab = read_shared(path)
    key, n = tab["key"].to_numpy().astype(np.int64), tab["n"].to_numpy()
    single = key < 1 << 21
    pairs = key[~single]
    return Bigrams(dict(zip(key[single].tolist(), n[single].tolist(), strict=True)), pairs - (1 << 21), n[~single])


def train(documents: DataFrame, text: str = "text", rounds: int = 1) -> str:
    """Counts of characters and pairs over all documents held clean; the path of the table.

    Round 0 leaves out texts that decode as UTF-8 somewhere or hold lost signs; each further round
    leaves out those the model so far labels. The table has at most one row a pair of alphabetic
    code points seen, a size bounded by the writing systems and not by the documents.
    """
    path = None
    for _ in range(rounds):
        new = scratch_path(documents.sparkSession, "characters")
        counts = documents.select(text).mapInArrow(_count(path), "key long, n long")
        counts.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1 OR key < 2097152").write.parquet(new)
        path = new
    return path


def repair(documents: DataFrame, text: str = "text", rounds: int = 1) -> DataFrame:
    """``documents`` with restored STRING, garbled BOOLEAN and whole BOOLEAN (nothing was lost) added.

    A null or empty text is not garbled and restores to itself; so does a clean one. Texts are read
    whole, each in time linear in its length. Columns of the added names are replaced.
    """
    documents = spread(documents)
    path = train(documents, text, rounds)

    @F.arrow_udf("struct<restored:string,garbled:boolean,whole:boolean>")
    def fix(column: pa.Array) -> pa.Array:
        decoder = Decoder(load_model(path))
        restored, garbled, whole = [], [], []
        values = column.to_pylist()
        found: dict[int, list] = {}
        at = [k for k, v in enumerate(values) if v and not v.isascii()]
        for run in _runs(at, lambda k: len(values[k])):
            found.update(zip(run, decoder.label_all([values[k] for k in run]), strict=True))
        for k, value in enumerate(values):
            spans = found.get(k, ())
            made, ok = decoder.restore(value, spans) if spans else (value, True)
            restored.append(made), garbled.append(bool(spans)), whole.append(ok)
        return pa.StructArray.from_arrays([pa.array(restored, pa.string()), pa.array(garbled), pa.array(whole)], ["restored", "garbled", "whole"])

    fix = fix.asNondeterministic()  # else a filter on its result would move it below the spreading
    kept = [c for c in documents.columns if c not in ("restored", "garbled", "whole") or c == text]
    fixed = documents.select(*kept).withColumn("_fix", fix(F.col(text)))
    return fixed.select(*kept, "_fix.restored", "_fix.garbled", "_fix.whole")
