"""One consistent form for text that reads the same (problem 5).

``reading_form`` maps a text to the form that stands for all texts looking like
it: full- and half-width forms, font variants, radicals and ligatures become
plain characters; every kind of blank becomes a space; characters without
width vanish; look-alike letters of other scripts become Latin ones inside
words that hold nothing but look-alikes; marks are ordered and composed.
Case, accents, superscripts, circled numbers, fractions, repeated blanks and
line breaks are kept: they read differently.

The work is done on numpy code-point arrays of whole Arrow batches: table
gathers, expansion offsets and vector composition; no call per row.

Defined results: null stays null, empty stays empty; a text that holds only
characters without width becomes empty; length is not limited.
"""

from __future__ import annotations

import unicodedata as ud
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at
from .workspace import chunked, crossed, written

# Look-alike letters and the Latin letters they are drawn like.
LOOKALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v",
    # other scripts and phonetic letters
    "օ": "o", "ɑ": "a", "ɡ": "g",
}

# Radicals that have no decomposition in Unicode, with the ideograph they are drawn like.
RADICALS = {
    "⺁": "厂", "⺄": "乙", "⺅": "亻", "⺇": "几", "⺉": "刂", "⺋": "㔾", "⺎": "兀", "⺐": "尢", "⺒": "巳", "⺓": "幺", "⺕": "彐", "⺖": "忄", "⺗": "㣺", "⺘": "扌", "⺙": "攵", "⺛": "旡", "⺜": "日", "⺝": "月", "⺠": "民", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺤": "爫", "⺦": "丬", "⺨": "犭", "⺬": "示", "⺭": "礻", "⺮": "竹", "⺰": "纟", "⺶": "羊", "⺻": "聿", "⺼": "肉", "⺾": "艹", "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻉": "贝", "⻊": "足", "⻋": "车", "⻌": "辶", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠", "⻠": "饣", "⻡": "首", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "斉", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙",
}

_ZWJ = 0x200D
_MAX = 0x110000
#: Compatibility tags whose characters read like the plain ones.
_SAME_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Ranges of <compat> characters that read like the plain ones: radicals, ligatures, Roman numerals.
_SAME_COMPAT = ((0x2E80, 0x2FDF), (0xFB00, 0xFB06), (0x2160, 0x217F))


class Tables:
    """Lookup tables over all code points, built by rule from the Unicode database."""

    def __init__(self) -> None:
        cat = np.zeros(_MAX, np.uint8)
        known = {}
        names = [known.setdefault(ud.category(chr(c)), len(known)) for c in range(0x32400)]
        cat[:0x32400] = names
        for lo, hi in ((0xE0000, 0xE0200), (0xF0000, _MAX)):
            cat[lo:hi] = [known.setdefault(ud.category(chr(c)), len(known)) for c in (range(lo, hi) if hi - lo < 4096 else (lo,))] if hi - lo < 4096 else known.setdefault("Co", len(known))
        is_cat = lambda *k: np.isin(cat, [known[x] for x in known if x[0] in k or x in k])
        self.letter = is_cat("L")
        self.mark = is_cat("M")
        self.ccc = np.zeros(_MAX, np.uint8)
        self.length = np.ones(_MAX, np.uint8)
        self.start = np.zeros(_MAX, np.int32)
        pool: list[int] = []
        pairs: dict[int, int] = {}
        flag = np.zeros(_MAX, bool)
        maps = {ord(a): b for a, b in RADICALS.items()}
        for c in range(0x32400):
            ch = chr(c)
            if (k := ud.combining(ch)) > 0:
                self.ccc[c] = k
                flag[c] = True
            d = ud.decomposition(ch)
            if not d or c in maps:
                continue
            if d[0] != "<":
                maps[c] = ud.normalize("NFD", ch)
                parts = [int(x, 16) for x in d.split()]
                if len(parts) == 2 and ud.normalize("NFC", "".join(map(chr, parts))) == ch:
                    pairs[parts[0] << 21 | parts[1]] = c
                    flag[parts[1]] = True
                if ud.normalize("NFC", ch) != ch:
                    flag[c] = True
            elif d.startswith(_SAME_TAGS) or any(lo <= c <= hi for lo, hi in _SAME_COMPAT):
                maps[c] = ud.normalize("NFD", "".join(chr(int(x, 16)) for x in d.split()[1:]))
                flag[c] = True
        # mapped targets may themselves be mapped (a half-width mark, say): resolve until stable
        for c in list(maps):
            for _ in range(4):
                s = "".join(maps.get(ord(x), x) if ord(x) != c else x for x in maps[c])
                if s == maps[c]:
                    break
                maps[c] = s
        for c in (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000):
            maps[c] = " "
        for c in (0x2010, 0x2011):
            maps[c] = "-"
        for c in (0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE0E), 0xFEFF, 0xFFA0, *range(0xE0100, 0xE01F0)):
            maps[c] = ""
        for c in (0x00A0, *(c for c in maps if maps[c] in (" ", "-", "")), *map(ord, RADICALS)):
            flag[c] = True
        for c, s in maps.items():
            self.length[c] = len(s)
            self.start[c] = len(pool)
            pool += map(ord, s)
        self.mapped = np.zeros(_MAX, bool)
        self.mapped[list(maps)] = True
        self.pool = np.array(pool, np.uint32)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        flag[0x1161:0x1176] = flag[0x11A8:0x11C3] = True  # vowels and finals of Hangul syllables
        self.alike = np.zeros(_MAX, np.uint32)
        self.alike[[ord(a) for a in LOOKALIKES]] = [ord(b) for b in LOOKALIKES.values()]
        flag[[ord(a) for a in LOOKALIKES]] = True
        #: letters of scripts with look-alikes that have none themselves: their words are left as they are
        self.foreign = np.zeros(_MAX, bool)
        for lo, hi in ((0x0370, 0x0590), (0x1F00, 0x2000)):
            self.foreign[lo:hi] = self.letter[lo:hi]
        self.foreign &= self.alike == 0
        for c, s in maps.items():  # precomposed letters of those scripts decompose first
            if self.foreign[c]:
                flag[c] |= any(self.alike[ord(x)] for x in s)
        self.picture = np.zeros(_MAX, bool)
        for lo, hi in ((0x2190, 0x2C00), (0x1F000, 0x20000), (0xFE0E, 0xFE10)):
            self.picture[lo:hi] = True
        self.flag = flag


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def _compose(cps: np.ndarray, row: np.ndarray, src: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order marks by class, then join each with its starter, pass by pass."""
    while True:
        n = len(cps)
        if n < 2:
            return cps, row, src
        ccc = t.ccc[cps]
        new_row = np.empty(n, bool)
        new_row[0] = True
        np.not_equal(row[1:], row[:-1], out=new_row[1:])
        begins = (ccc == 0) | new_row
        group = np.cumsum(begins)
        if ((ccc[1:] < ccc[:-1]) & (ccc[1:] > 0) & ~new_row[1:]).any():
            order = np.argsort(group * 256 + ccc, kind="stable")
            cps, ccc, src = cps[order], ccc[order], src[order]
        starter = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        prev = np.arange(n) - 1
        direct = prev == starter
        # a mark joins the starter before it unless a mark of the same class stands between;
        # a starter joins the one right before it
        mark = (ccc > 0) & ~begins
        mark[1:] &= direct[1:] | (ccc[:-1] < ccc[1:])
        i = np.flatnonzero(mark)
        s = starter[i]
        j = np.flatnonzero((ccc == 0) & ~new_row)
        j = j[begins[j - 1] & (ccc[j - 1] == 0)]
        i, s = np.concatenate([i, j]), np.concatenate([s, j - 1])
        ok = ccc[s] == 0
        i, s = i[ok], s[ok]
        a, b = cps[s].astype(np.int64), cps[i].astype(np.int64)
        at_ = np.minimum(np.searchsorted(t.pair_keys, a << 21 | b), len(t.pair_keys) - 1)
        to = np.where(t.pair_keys[at_] == (a << 21 | b), t.pair_to[at_], 0).astype(np.int64)
        lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        to = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28, to)
        lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        to = np.where(lvt, a + b - 0x11A7, to)
        hit = to > 0
        if not hit.any():
            return cps, row, src
        i, s, to = i[hit], s[hit], to[hit]
        order = np.lexsort((i, s))
        i, s, to = i[order], s[order], to[order]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        # a starter that is swallowed in this pass doesn't swallow another in the same pass
        i, s, to = i[first], s[first], to[first]
        gone = np.zeros(n, bool)
        gone[i] = True
        keep = ~gone[s]
        i, s, to = i[keep], s[keep], to[keep]
        cps = cps.copy()
        cps[s] = to
        gone[:] = True
        gone[i] = False
        cps, row, src = cps[gone], row[gone], src[gone]


def normalise(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The reading form of each row of flat code points."""
    return traced(cps, off)[:2]


def traced(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The reading form, and for each of its characters the place in ``cps`` it comes from (None if nothing changed)."""
    t = tables()
    n_rows = len(off) - 1
    touched = np.flatnonzero(t.flag[cps])
    if not len(touched):
        return cps, off, None
    rows = np.unique(np.searchsorted(off, touched, side="right") - 1)
    sub, sub_off = at.take_rows(cps, off, rows)
    row = at.row_of(sub_off)
    # expansion
    lens = t.length[sub].astype(np.int64)
    z = np.flatnonzero(sub == _ZWJ)
    z = z[(z > 0) & (z < len(sub) - 1)]
    z = z[t.picture[sub[z - 1]] & t.picture[sub[z + 1]] & (row[z - 1] == row[z + 1])]
    lens[z] = 1
    ends = np.cumsum(lens)
    src = np.repeat(np.arange(len(sub)), lens)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens, lens)
    from_pool = t.mapped[sub[src]]
    from_pool &= sub[src] != _ZWJ
    out = sub[src]
    if from_pool.any():
        out = np.where(from_pool, t.pool[np.where(from_pool, t.start[sub[src]] + within, 0)], out)
    row = row[src]
    # look-alikes, by words
    alike = t.alike[out]
    if alike.any():
        inside = t.letter[out] | t.mark[out]
        edge = np.ones(len(out), bool)
        edge[1:] = (inside[1:] != inside[:-1]) | (row[1:] != row[:-1])
        word = np.cumsum(edge) - 1
        kept = np.zeros(word[-1] + 1, bool)
        kept[word[t.foreign[out]]] = True
        out = np.where((alike > 0) & ~kept[word], alike, out)
    out, row, src = _compose(out.astype(np.uint32), row, src, t)
    sub_lens = np.bincount(row, minlength=len(rows))
    new_off = np.zeros(n_rows + 1, np.int64)
    all_lens = np.diff(off)
    all_lens[rows] = sub_lens
    np.cumsum(all_lens, out=new_off[1:])
    res = np.empty(new_off[-1], np.uint32)
    is_sub = np.zeros(n_rows, bool)
    is_sub[rows] = True
    mask = np.repeat(is_sub, all_lens)
    res[mask] = out
    plain = np.flatnonzero(np.repeat(~is_sub, np.diff(off)))
    res[~mask] = cps[plain]
    places = np.empty(new_off[-1], np.int64)
    places[~mask] = plain
    places[mask] = src + np.repeat(off[rows] - sub_off[:-1], sub_lens)
    return res, new_off, places


def normalise_arrow(col: pa.Array) -> pa.Array:
    """The reading form of an Arrow string column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    cps, off = at.to_codepoints(col)
    return at.from_codepoints(*normalise(cps, off), at.null_mask(col))


@F.arrow_udf(T.StringType())
def _reading_udf(col: pa.Array) -> pa.Array:
    return normalise_arrow(col).cast(pa.string())


def reading_form(col: Column | str) -> Column:
    """Column expression: the reading form of a string column."""
    return _reading_udf(F.col(col) if isinstance(col, str) else col)


def same_reading(df: DataFrame, on: list[str], key: str, value: str) -> DataFrame:
    """(on..., id_a, id_b), id_a < id_b: rows whose values read the same but aren't the same string.

    Rows are grouped by the digest of their reading form and, within it, by that of
    the string; only forms with several strings go on, so a value that many rows
    hold unchanged costs one aggregation.  All rows of different strings pair, by
    lists of bounded length, so that no task has more than its share of the pairs.

    Defined results: null values pair with nothing; redelivered rows count once.
    """
    rows = df.where(F.col(value).isNotNull()).select(*on, F.col(key).cast("string").alias("id"), F.unhex(F.md5(F.encode(reading_form(value), "utf-8"))).alias("form"), F.unhex(F.md5(F.encode(F.col(value), "utf-8"))).alias("raw")).distinct()
    rows = written(rows, "reading")
    strings = rows.groupBy(*on, "form", "raw").agg(F.count("*").alias("n"))
    several = strings.groupBy(*on, "form").agg(F.count("*").alias("strings")).where("strings > 1").select(*on, "form")
    strings = strings.join(several, [*on, "form"], "left_semi")
    members = rows.join(strings.select(*on, "form", "raw", F.col("n").alias("copies")), [*on, "form", "raw"])
    lists = written(chunked(members, [*on, "form", "raw"]), "lists")
    side = lambda x: lists.select(*on, "form", F.col("raw").alias(f"raw_{x}"), F.col("ids").alias(f"{x}s"))
    both = crossed(side("x").join(side("y"), [*on, "form"]).where("raw_x < raw_y"), on)
    return both.where("x != y").select(*on, F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
