"""Variant spellings of one person or collaboration, by a pigeonhole segment join.

Every spelling gives a few key strings: its parts run together in either order, and its family name
under the initial of a given name. A string within one edit of another agrees with it in one of two
segments at a known shift, so segments go into an inverted index and shifted substrings are looked
up in it. Candidates are settled by a banded edit distance and by what initials, short forms,
particles, titles and double names allow. Links over a fully spelt name are followed one step.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.session import materialize

#: Titles, particles and words of a collaboration's name.
TITLES = frozenset(("dr", "prof", "phd", "professor", "doctor"))
PARTICLES = frozenset(("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "das", "du", "ten", "ter", "la", "le", "al", "el", "bin", "ibn", "zu", "zur"))
GROUP_WORDS = frozenset(("collaboration", "collaborations", "collab", "consortium", "experiment", "team", "group", "project", "working", "cons", "consort", "coll", "exp"))
#: Customary short forms of given names that aren't their beginnings.
SHORT_FORMS = {
    "alexander": "sasha xander alex", "andrew": "drew andy", "anthony": "tony", "catherine": "kate katie kathy kitty cathy", "charles": "charlie chuck chas", "christopher": "kit topher chris",
    "daniel": "danny", "deborah": "debbie", "dorothy": "dot dottie dolly", "edward": "ted teddy ned eddie", "elizabeth": "liz lizzie beth betty betsy libby", "eugene": "gene",
    "francesca": "fanny franca fran", "francis": "frank", "gabriel": "gabe", "gregory": "greg", "helen": "nell nellie", "henry": "hank harry hal", "isabella": "bella izzy", "jacob": "jake",
    "james": "jim jimmy jamie", "jennifer": "jenny", "john": "jack", "jonathan": "jonny jon", "joseph": "joe joey", "katarina": "katya kat kata", "lawrence": "larry", "leonard": "lenny leo",
    "margaret": "peggy meg maggie marge daisy", "mary": "molly polly", "michael": "mike mick mickey", "nicholas": "nick nicky klaus", "oliver": "ollie", "patricia": "patty trish tricia",
    "patrick": "paddy", "rebecca": "becky becca", "richard": "dick rick ricky", "robert": "bob bobby", "samuel": "sammy", "sarah": "sally", "sebastian": "bastian", "stephanie": "steffi",
    "susan": "sue susie", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "timmy", "victoria": "tori vicky", "vincent": "vinnie", "william": "bill billy willy", "zachary": "zack",
}
_FORMAL: dict[str, tuple[str, ...]] = {}
for _full, _shorts in SHORT_FORMS.items():
    for _s in _shorts.split():
        _FORMAL[_s] = (*_FORMAL.get(_s, ()), _full)
_KEEP = re.compile(r"[^a-z0-9\s]")
#: Further forms that a spelling and its near namesake each need to count as two authors.
FORMS = 2


def normalize(text: str) -> str:
    """Compatibility-decomposed ASCII in lower case, letters and digits with single spaces."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return " ".join(_KEEP.sub("", plain).split())


_SPELLED_UMLAUT = re.compile("([aou])e")


def fold(text: str) -> str:
    """Spelled-out umlauts as the plain vowels that dropping the dots leaves."""
    return _SPELLED_UMLAUT.sub(r"\1", text)


def one_edit(a: str, b: str) -> bool:
    """Whether a and b are equal or one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 1] == b[i + 1 : i + 2] and a[i + 1 : i + 2] == b[i : i + 1] and a[i + 2 :] == b[i + 2 :])


#: Particles that are often written as one word with the name.
_GLUED = ("vander", "vonder", "van", "von", "del", "ten", "de")


class Name:
    """A spelling with the ways to read it. ``split`` is the spelling with hyphens as spaces, where known."""

    def __init__(self, spelling: str, split: str) -> None:
        self.spelling = spelling
        words = spelling.split()
        self.is_group = any(w in GROUP_WORDS for w in words)
        if self.is_group:
            core = [w for w in words if w not in GROUP_WORDS and w != "the"]
            # An acronym is its own core; letters are sorted, so the order of the words doesn't count.
            self.core, self.acronym = "".join(sorted("".join(core))), "".join(w[0] for w in core)
            self.readings, self.whole = [], []
            return
        self.parts = _hyphens(words, split)
        self.core_words = _core(words)
        self.readings = list(dict.fromkeys(self._readings()))
        bare = [p + w for p, w in self.core_words]
        n = len(bare)
        turns = {tuple(bare[k:] + bare[:k]) for k in (0, 1, n - 1)} if n else set()
        self.whole = sorted({fold("".join(t)) for t in turns})
        #: Given names written out; only such spellings connect others.
        self.full = any(len(g[0]) > 2 for _, g, _ in self.readings if g) or n == 1

    def _readings(self):
        """(family name, given names, written in one order or the other)."""
        words = self.core_words
        n = len(words)
        if n == 1:
            return
        family = lambda group: "".join(w for _, w in group)
        for size in (1, 2):
            if n > size:
                for group, given, order in ((words[:size], words[size:], "first"), (words[n - size :], words[: n - size], "last")):
                    names = tuple(w for p, w in given)
                    s = fold(family(group))
                    if len(s) < 3 or (size == 2 and min(len(w) for _, w in group) < 3):
                        continue
                    yield s, names, order
                    if size == 1:
                        for p in _GLUED:
                            if s.startswith(p) and len(s) >= len(p) + 5:
                                yield s[len(p) :], names, order
                        halves = self.parts.get(group[0][1])
                        if halves and len(halves) == 2:
                            a, b = map(fold, halves)
                            for other in (b + a, a, b):
                                if len(other) > 2:
                                    yield other, names, order
                        if group[0][0]:
                            yield fold(group[0][0]) + s, names, order

    def initials(self, given: tuple[str, ...]) -> list[str]:
        """The sequences of initials ``given`` may be shortened to."""
        out = ["".join(g[0] for g in given)]
        split = [h for g in given for h in self.parts.get(g, (g,))]
        out.append("".join(h[0] for h in split))
        for formal in _FORMAL.get(given[0], ()):
            out.append(formal[0] + out[0][1:])
        return out


def _hyphens(words: list[str], split: str) -> dict[str, tuple[str, ...]]:
    out, pieces, at = {}, split.split(), 0
    for w in words:
        taken, built = [], ""
        while at < len(pieces) and len(built) < len(w):
            built += pieces[at]
            taken.append(pieces[at])
            at += 1
        if built != w:
            return out
        if len(taken) > 1:
            out[w] = tuple(taken)
    return out


def _core(words: list[str]) -> list[tuple[str, str]]:
    """(particles run together, word) of the words that aren't titles."""
    rest = [w for i, w in enumerate(words) if w not in TITLES or (w == "dr" and i and len(words) == 2)]
    out, held = [], ""
    for w in rest or words:
        if w in PARTICLES:
            held += w
        else:
            out.append((held, w))
            held = ""
    if held:
        out.append(("", held))
    if len(out) == 1 and len(out[0][0]) == 2 and len(words) == 2:  # "el smith": initials that look like a particle
        out = [("", out[0][0]), ("", out[0][1])]
    return out


def _within(short: str, long: str) -> bool:
    it = iter(long)
    return short[:1] == long[:1] and all(c in it for c in short)


def _is_initials(given: tuple[str, ...]) -> bool:
    return all(len(g) <= 2 for g in given)


def _same_given(a: str, b: str) -> int | None:
    """0 for one name (equal, short form, beginning), 1 for one with a typing error, None for two names."""
    fa, fb = _FORMAL.get(a, ()), _FORMAL.get(b, ())
    a, b = fold(a), fold(b)
    if a == b:
        return 0
    if b in map(fold, fa) or a in map(fold, fb) or set(fa) & set(fb):
        return 0
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and long.startswith(short) and len(long) - len(short) != 1:
        return 0
    for x in fa:
        if len(b) > 4 and one_edit(x, b):
            return 1
    for x in fb:
        if len(a) > 4 and one_edit(x, a):
            return 1
    if len(short) >= 3 and one_edit(a, b):
        return 1
    return None


def _given(a: Name, ga: tuple[str, ...], b: Name, gb: tuple[str, ...]) -> tuple[int, bool] | None:
    """(typing errors, whether initials were used) if the given names may be one person's."""
    if "".join(ga) == "".join(gb):
        return 0, _is_initials(ga)
    ia, ib = _is_initials(ga), _is_initials(gb)
    if ia and ib:
        x, y = sorted(("".join(ga), "".join(gb)), key=len)
        return (0, True) if _within(x, y) else None
    if ia or ib:
        short, name, full = ("".join(ga), b, gb) if ia else ("".join(gb), a, ga)
        return (0, True) if any(_within(*sorted((short, option), key=len)) for option in name.initials(full)) else None
    errors = _same_given(ga[0], gb[0])
    if errors is None:
        fa, fb = "".join(ga), "".join(gb)
        return (1, False) if min(len(fa), len(fb)) > 4 and one_edit(fold(fa), fold(fb)) else None
    if len(ga) > 1 and len(gb) > 1:
        ra, rb = "".join(g[0] for g in ga[1:]), "".join(g[0] for g in gb[1:])
        x, y = sorted((ra, rb), key=len)
        if x[0] != y[0] and not _within(x, y):
            return None
    return errors, False


@lru_cache(maxsize=200_000)
def read_name(packed: str) -> Name:
    spelling, _, split = packed.partition("\x1f")
    return Name(spelling, split)


def linked(a: Name, b: Name) -> tuple[int, bool] | None:
    """(typing errors, whether only initials join them) if the spellings may be one author's, else None."""
    if a.is_group or b.is_group:
        return _same_group(a, b)
    best: tuple[int, bool] | None = None
    for x in a.whole:
        for y in b.whole:
            if min(len(x), len(y)) >= 6 and one_edit(x, y):
                if x == y and a.full and b.full:
                    return 0, False
                if len(a.core_words) == 1 or len(b.core_words) == 1:
                    best = (1, False)
    for sa, ga, _ in a.readings:
        for sb, gb, _ in b.readings:
            if sa == sb:
                typed = 0
            elif min(len(sa), len(sb)) >= 5 and one_edit(sa, sb):
                typed = 1
            else:
                continue
            given = _given(a, ga, b, gb)
            if given is not None and typed + given[0] <= 1:
                found = (typed + given[0], given[1])
                best = found if best is None else min(best, found)
                if best == (0, False):
                    return best
    return best


def _same_group(a: Name, b: Name) -> tuple[int, bool] | None:
    if a.is_group and b.is_group:
        if a.core == b.core or (len(a.core) > 3 and a.core == "".join(sorted(b.acronym))) or (len(b.core) > 3 and b.core == "".join(sorted(a.acronym))):
            return 0, False
        return (1, False) if min(len(a.core), len(b.core)) > 4 and one_edit(a.core, b.core) else None
    group, other = (a, b) if a.is_group else (b, a)
    if len(other.core_words) == 1 and len(word := other.core_words[0][1]) > 3:
        if "".join(sorted(word)) in (group.core, "".join(sorted(group.acronym))) and word in (group.acronym, *group.spelling.split()):
            return 0, False
    return None


def conflict(a: Name, b: Name) -> bool:
    """Whether two spellings that some third one links can't be one author: other given names, other middle initials."""
    if a.is_group or b.is_group or len(a.core_words) == 1 or len(b.core_words) == 1:
        return False
    for sa, ga, _ in a.readings:
        for sb, gb, _ in b.readings:
            if abs(len(sa) - len(sb)) <= 2 and (sa == sb or one_edit(sa, sb) or _two_edits(sa, sb)):
                if _is_initials(ga) or _is_initials(gb):
                    if _given(a, ga, b, gb) is not None:
                        return False
                elif _same_given(ga[0], gb[0]) is not None or _two_edits(ga[0], gb[0]):
                    if len(ga) < 2 or len(gb) < 2 or ga[1][0] == gb[1][0]:
                        return False
    return True


def _two_edits(a: str, b: str) -> bool:
    """Whether some string is within one edit of both, for strings of six characters and more."""
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 2:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    ra, rb = a[i:], b[i:]
    options = [(ra[1:], rb), (ra, rb[1:]), (ra[1:], rb[1:])]
    if len(ra) > 1:
        options.append((ra[1::-1] + ra[2:], rb))
    return any(one_edit(x, y) for x, y in options)


def keys(name: Name) -> list[str]:
    if name.is_group:
        return ["g" + name.core] + (["g" + "".join(sorted(name.acronym))] if len(name.acronym) > 3 else [])
    out = ["w" + w for w in name.whole]
    if len(name.core_words) == 1:
        out.append("g" + "".join(sorted(name.core_words[0][1])))
    for s, given, _ in name.readings:
        for initial in {i[0] for i in name.initials(given)}:
            out.append(initial + s)
    return list(dict.fromkeys(out))


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def segments(key: str) -> tuple[list[int], list[int]]:
    """(index entries, lookups) of a key: two halves; lookups at the shifts one edit can cause.

    A string finds strings of its own length and shorter ones, so each pair is found from one side.
    """
    tag, s = key[0], key[1:]
    n = len(s)
    index = [_hash(tag, n, 0, s[: n // 2]), _hash(tag, n, 1, s[n // 2 :])]
    half = n // 2
    look = {_hash(tag, n, 0, s[:half]), _hash(tag, n, 1, s[half:])}
    if n > 1:  # a swap across the middle spoils both halves
        swapped = s[: half - 1] + s[half] + s[half - 1] + s[half + 1 :] if half else s
        look |= {_hash(tag, n, 0, swapped[:half]), _hash(tag, n, 1, swapped[half:])}
        m = n - 1
        look |= {_hash(tag, m, 0, s[: m // 2]), _hash(tag, m, 1, s[m // 2 + 1 :])}
    return index, list(look)


def _spell(column: pa.Array) -> pa.StructArray:
    plain, split = [], []
    for raw in column.to_pylist():
        a = normalize(raw)
        b = normalize(re.sub(r"[-‐‑–]", " ", raw))
        plain.append(a), split.append(b if b != a else "")
    return pa.StructArray.from_arrays([pa.array(plain), pa.array(split)], ["spelling", "split"])


def spellings(names: DataFrame, column: str) -> DataFrame:
    """(spelling, split): the distinct normalised spellings of ``names``, with hyphens seen as spaces where some row has them."""
    spell = _spell_udf()
    raw = names.filter(F.col(column).isNotNull()).select(F.col(column).alias("raw")).distinct()
    made = raw.select(spell("raw").alias("s")).select("s.spelling", "s.split").filter("spelling <> ''")
    return made.groupBy("spelling").agg(F.max("split").alias("split"))


def _spell_udf():
    @F.arrow_udf("struct<spelling:string,split:string>")
    def spell(column: pa.Array) -> pa.Array:
        return _spell(column)

    return spell


def _known_splits(found: DataFrame) -> DataFrame:
    """Spellings written without hyphens get those their words have elsewhere."""
    words = found.select("spelling", "split", F.posexplode(F.split("spelling", " ")).alias("at", "word"))

    def parts(batches):
        for batch in batches:
            seen = {}
            for spelling, split in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if split:
                    seen.update({w: " ".join(p) for w, p in _hyphens(spelling.split(), split).items()})
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.string())], ["word", "pieces"])

    known = found.filter("split <> ''").select("spelling", "split").mapInArrow(parts, "word string, pieces string").groupBy("word").agg(F.max("pieces").alias("pieces"))
    joined = words.join(known, "word", "left").withColumn("piece", F.struct("at", F.coalesce("pieces", "word").alias("w")))
    whole = joined.groupBy("spelling").agg(F.array_sort(F.collect_list("piece")).alias("p"))
    return whole.select(F.concat_ws("\x1f", "spelling", F.array_join(F.transform("p", lambda p: p["w"]), " ")).alias("name"))


def _index(batches):
    for batch in batches:
        entry, name, side = [], [], []
        for packed in batch.column(0).to_pylist():
            index, look = set(), set()
            for key in keys(read_name(packed)):
                i, k = segments(key)
                index.update(i), look.update(k)
            for h in index:
                entry.append(h), name.append(packed), side.append(True)
            for h in look:
                entry.append(h), name.append(packed), side.append(False)
        yield pa.RecordBatch.from_arrays([pa.array(entry, pa.int64()), pa.array(name, pa.string()), pa.array(side)], ["entry", "name", "stored"])


def _verify(batches):
    for batch in batches:
        a_, b_, typed, initials = [], [], [], []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            how = linked(read_name(a), read_name(b))
            if how:
                a_.append(a), b_.append(b), typed.append(how[0] > 0), initials.append(how[1])
        yield pa.RecordBatch.from_arrays([pa.array(a_, pa.string()), pa.array(b_, pa.string()), pa.array(typed, pa.bool_()), pa.array(initials, pa.bool_())], ["a", "b", "typed", "initials"])


def _compatible(batches):
    for batch in batches:
        pairs = [(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if not conflict(read_name(a), read_name(b))]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["a", "b"])


def _full(batches):
    for batch in batches:
        yield batch.filter(pa.array([read_name(z).is_group or read_name(z).full for z in batch.column(0).to_pylist()], pa.bool_()))


def variant_pairs(names: DataFrame, column: str = "name") -> DataFrame:
    """(name_a, name_b): pairs of different normalised spellings of one author, smaller first, each once.

    Nulls and names without a letter or digit are left out; repeated names count once. A spelling
    that fits two authors (an initial) is paired with the spellings of both. Work grows with the
    distinct spellings, not with the rows: names are made distinct in the map tasks first.
    """
    spelt = materialize(spellings(names, column), "spellings")
    packed = _known_splits(spelt)
    entries = materialize(packed.mapInArrow(_index, "entry long, name string, stored boolean"), "segments")
    stored = entries.filter("stored").select("entry", F.col("name").alias("a"))
    asked = entries.filter("NOT stored").select("entry", F.col("name").alias("b"))
    candidates = stored.join(asked, "entry").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = materialize(candidates.mapInArrow(_verify, "a string, b string, typed boolean, initials boolean"), "links")
    # A typing error is a stray; a name with several further forms of its own is somebody else's, however near.
    exact = found.filter("NOT typed AND NOT initials")
    ends = exact.select(F.col("a").alias("n")).unionByName(exact.select(F.col("b").alias("n")))
    settled = ends.groupBy("n").count().filter(F.col("count") >= FORMS).select("n")
    doubt = found.filter("typed").select("a", "b")
    twins = doubt.join(settled.withColumnRenamed("n", "a"), "a", "left_semi").join(settled.withColumnRenamed("n", "b"), "b", "left_semi")
    links = materialize(found.join(twins, ["a", "b"], "left_anti").select("a", "b", (~F.col("initials")).alias("strong")), "settled")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "strong"))
    hub = both.select(F.col("a").alias("z"), F.col("b").alias("n"), "strong").mapInArrow(_full, "z string, n string, strong boolean")
    one = hub.filter("strong").select("z", F.col("n").alias("x"))
    two = one.join(hub.select("z", F.col("n").alias("y")), "z").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    further = two.join(links.select("a", "b"), ["a", "b"], "left_anti").mapInArrow(_compatible, "a string, b string")
    pairs = links.select("a", "b").unionByName(further)
    name = lambda c: F.substring_index(c, "\x1f", 1)
    return pairs.select(F.least(name("a"), name("b")).alias("name_a"), F.greatest(name("a"), name("b")).alias("name_b")).filter("name_a <> name_b").distinct()
