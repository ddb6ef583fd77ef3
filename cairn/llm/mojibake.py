"""Garbled text from wrong character encoding (problem 8).

Method: round-trip repair.  Text is encoded back under a candidate legacy
encoding and strictly decoded as the encoding it was meant to be in, stretch by
stretch; a stretch is taken when its garbling cost drops, and the whole is
repeated for nested layers.

The garbling cost is that of a character model: interpolated bigram counts over
all texts of the corpus, kept in tables of fixed size.  Suspects don't vote for
themselves: stretches that strictly decode as a multi-byte encoding aren't
counted, and copies of a text count by the logarithm of their number.  Repairs into a multi-byte
encoding work on maximal runs of strictly valid sequences of whole characters; between two
single-byte encodings (and between two double-byte ones) characters correspond
one to one, and the stretches are the spans with the largest total drops.  All
stretches of a text that don't overlap are taken at once, and again until no cost
drops.  A stretch is only taken if garbling its repair gives it back.

Texts are screened whole batches at a time: tables turn code points into bytes of
each encoding, and only runs of high bytes that strictly decode are looked at one
by one.  U+FFFD, stray controls and bytes left over beside a restored run mean
that something was lost: such a text is garbled but not ``complete``.

Defined results: null and empty texts are not garbled; texts of any length are
read whole; redelivered rows give one row for each id and text.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from . import words as w
from .workspace import slices

#: Buckets of the bigram counts (a fixed size whatever the corpus).
PAIR_BITS = 21
_POINTS = 0x30000
#: Drops of the garbling cost, in nats, from which a repair is taken: of all runs of one encoding in a text, and of a span.
TAKE_RUN, TAKE_SPAN = 3.0, 9.0
#: What a repair from the text's main encoding is preferred by, in nats.
IN_DOUBT = 2.0
#: Layers of one encoding that are undone in one step if that costs less than one by one.
LAYERS = 4

# Encodings that text is wrongly read in, by the encoding it was meant to be in.
INTO_UTF8 = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r")
INTO_GBK = ("cp1252", "latin-1", "mac_roman", "cp1251")
ONE_TO_ONE = (
    ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1250", "cp1252"), ("koi8_r", "cp1252"),
    ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("mac_roman", "cp1251"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"),
    ("big5hkscs", "gbk"), ("gbk", "big5hkscs"), ("cp932", "gbk"), ("euc_kr", "gbk"),
)

_TWO, _THREE = rb"[\xC2-\xDF][\x80-\xBF]", rb"\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
_FOUR = rb"\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
_UTF8 = re.compile(b"(?:" + b"|".join((_TWO, _THREE, _FOUR)) + b")+")
_GBK = re.compile(rb"(?:[\xA1-\xF7][\xA1-\xFE]){2,}")
#: UTF-8 read as GBK: letters, signs and ideographs; a trail byte may be an ASCII letter that was drawn in.
_UTF8_IN_GBK = re.compile(rb"(?:(?:[\xE3-\xE9][\x80-\xBF]{2}|\xEF[\xBC\xBD][\x80-\xBF]|\xE2[\x80-\x9F][\x80-\xBF]|[\xC3-\xC5][\x80-\xBF])[\x40-\x7E]?)+")
#: The same, at a length that GBK text doesn't reach by chance.
_LONG_IN_GBK = re.compile(rb"(?:[\xE3-\xE9][\x80-\xBF]{2}|\xEF[\xBC\xBD][\x80-\xBF]){3,}")


@lru_cache(None)
def char_table(enc: str) -> np.ndarray:
    """For each byte of a single-byte encoding its code point; undefined places hold the control of the same number."""
    out = np.arange(256, dtype=np.uint32)
    for b in range(128, 256):
        try:
            out[b] = ord(bytes([b]).decode(enc))
        except UnicodeError:
            pass
    return out


@lru_cache(None)
def byte_table(enc: str) -> np.ndarray:
    """For each code point its byte in a single-byte encoding, 0 if none."""
    out = np.zeros(_POINTS, np.uint8)
    out[char_table(enc)] = np.arange(256)
    return out


@lru_cache(1)
def gbk_table() -> np.ndarray:
    """For each code point its two bytes in GBK, as one number, 0 if none."""
    out = np.zeros(_POINTS, np.uint16)
    for lead in range(0x81, 0xFF):
        for trail in range(0x40, 0xFF):
            try:
                c = bytes([lead, trail]).decode("gbk")
            except UnicodeError:
                continue
            if len(c) == 1 and c.encode("gbk") == bytes([lead, trail]):
                out[ord(c)] = lead << 8 | trail
    return out


def gbk_bytes(cps: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code points in GBK (0 for those that have no place there), and where the bytes of each begin, with the end."""
    pair = gbk_table()[np.minimum(cps, _POINTS - 1)]
    at_ = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(1 + (pair > 0), out=at_[1:])
    out = np.zeros(at_[-1], np.uint8)
    out[at_[:-1]] = np.where(pair > 0, pair >> 8, np.where(cps < 128, cps, 0))
    two = np.flatnonzero(pair)
    out[at_[two] + 1] = pair[two] & 255
    return out.tobytes(), at_


@lru_cache(None)
def swap_table(read_in: str, meant: str) -> np.ndarray:
    """For each code point the one it was meant to be, 0 if none; plain ASCII stays."""
    out = np.zeros(_POINTS, np.uint32)
    out[:128] = np.arange(128)
    out[0xA0] = 0xA0  # a blank in every text, whatever its encoding
    for c in range(0xA1, 0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        try:
            b = chr(c).encode(read_in)
            s = b.decode(meant)
        except UnicodeError:
            continue
        if len(s) == 1 and len(b) == (2 if read_in in ("big5hkscs", "gbk", "cp932", "euc_kr") else 1):
            out[c] = ord(s)
    return out


class Model:
    """Character model: how many times each character, and each pair, occurs in the corpus."""

    def __init__(self, ones: np.ndarray, pairs: np.ndarray) -> None:
        self.ones, self.pairs, self.total = ones.astype(np.float64), pairs, max(1.0, float(ones.sum()))

    def cost(self, before: np.ndarray, here: np.ndarray) -> np.ndarray:
        """Nats of each character after the one before it."""
        a, b = np.minimum(before, _POINTS - 1), np.minimum(here, _POINTS - 1)
        single = (self.ones[b] + 0.05) / (self.total + 1)
        weight = 4.0
        # a bucket may hold other pairs, too: no pair is more frequent than either character
        both = np.minimum(self.pairs[pair_bucket(a, b)], np.minimum(self.ones[a], self.ones[b]))
        return -np.log((both + weight * single) / (self.ones[a] + weight))


def pair_bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (w.mix((a.astype(np.uint64) << np.uint64(21)) | b.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


#: What a garbled stretch would have been: letters and signs of common scripts. Other results of decoding are chance.
_USUAL = re.compile(r"[\x80-\u017fƒˆ˜Ά-ώЁА-яё‐-›€№™\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uff5e\U0001f300-\U0001faff]+")


def _high_pairs(flat: np.ndarray) -> np.ndarray:
    """Places where two characters of single-byte encodings beyond ASCII stand side by side."""
    high = (flat >= 0x80) & (flat < 0x2E80)
    return np.flatnonzero(high[:-1] & high[1:])


def _matches(pattern: re.Pattern, flat: np.ndarray, pairs: np.ndarray, enc: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes): maximal matches in the bytes of an encoding; tried only where two bytes can begin one."""
    table = byte_table(enc)
    a, c = table[flat[pairs]], table[flat[pairs + 1]]
    starts = pairs[(a >= 0xC2) & (a < 0xF5) & (c >= 0x80) & (c < 0xC0)] if pattern is _UTF8 else pairs[(a >= 0xA1) & (a < 0xF8) & (c >= 0xA1)]
    if not len(starts):
        return
    b, done = table[flat].tobytes(), 0
    for s in starts.tolist():
        if s >= done and (m := pattern.match(b, s)):
            done = m.end()
            yield s, done, m.group()


def _utf8_in_gbk(pattern: re.Pattern, b: bytes) -> Iterator[tuple[int, int]]:
    """Matches in GBK bytes, tried only where a sequence of UTF-8 can begin."""
    raw = np.frombuffer(b + b"\0\0", np.uint8)
    on = (raw & 0xC0) == 0x80
    lead = raw[:-2]
    done = 0
    for s in np.flatnonzero(on[1:-1] & ((lead >= 0xC3) & (lead < 0xC6) | on[2:] & ((lead >= 0xE2) & (lead < 0xEA) | (lead == 0xEF)))).tolist():
        if s >= done and (m := pattern.match(b, s)):
            done = m.end()
            yield s, done


def suspects(cps: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which characters of flat texts are in a stretch that strictly decodes as a multi-byte encoding.

    Cyrillic words always decode as GBK, so that reading of them is no ground.
    """
    flat, mask = np.minimum(np.insert(cps, off[1:], 10), _POINTS - 1), np.zeros(len(cps) + len(off) - 1, bool)  # no stretch runs from one text into the next
    pairs = _high_pairs(flat)
    for enc in dict.fromkeys(INTO_UTF8 + INTO_GBK):
        for pattern in [_UTF8] * (enc in INTO_UTF8) + [_GBK] * (enc in INTO_GBK and enc != "cp1251"):
            for s, e, b in _matches(pattern, flat, pairs, enc):
                try:
                    mask[s:e] |= bool(_USUAL.fullmatch(b.decode("utf-8" if pattern is _UTF8 else "gbk")))
                except UnicodeError:
                    pass
    b, at_ = gbk_bytes(flat)
    for s, e in _utf8_in_gbk(_LONG_IN_GBK, b):
        i, j = np.searchsorted(at_[1:], (s, e - 1), side="right")
        mask[i : j + 1] = True
    return np.delete(mask, off[1:] + np.arange(len(off) - 1))


def character_model(df: DataFrame, text: str) -> Model:
    """Counts over every text of ``df``, without stretches that may be garbled; what reaches the driver has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, pairs = np.zeros(_POINTS, np.int64), np.zeros(1 << PAIR_BITS, np.int64)
        for whole in batches:
            for b in slices(whole, [text]):
                cps, off = at.to_codepoints(b.column(text))
                clear = ~suspects(cps, off)
                cps = np.minimum(cps, _POINTS - 1)
                votes = 1 + np.floor(np.log2(b.column("copies").to_numpy())).astype(np.int64)
                votes = np.repeat(votes, np.diff(off)) * clear
                ones += np.bincount(cps, votes, _POINTS).astype(np.int64)
                if len(cps) > 1:
                    inside = clear.copy()
                    inside[1:] &= clear[:-1]
                    inside[off[:-1][off[:-1] < len(cps)]] = False
                    i = np.flatnonzero(inside)
                    pairs += np.bincount(pair_bucket(cps[i - 1], cps[i]), votes[i], len(pairs)).astype(np.int64)
        for kind, total in enumerate((ones, pairs)):
            some = np.flatnonzero(total)
            for k in range(0, len(some), 1 << 16):
                x = some[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x.astype(np.int32)), pa.array(total[x])], ["kind", "place", "n"])

    texts = df.where(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("copies"))
    got = texts.mapInArrow(run, "kind int, place int, n long").groupBy("kind", "place").agg(F.sum("n").alias("n")).toArrow()
    kind, place, n = (got[c].to_numpy() for c in ("kind", "place", "n"))
    ones, pairs = np.zeros(_POINTS, np.int64), np.zeros(1 << PAIR_BITS, np.float32)
    ones[place[kind == 0]] = n[kind == 0]
    pairs[place[kind == 1]] = n[kind == 1]
    return Model(ones, pairs)


@dataclass
class Part:
    """A stretch of a flat text that could be restored: where, from which encoding, to what; ``whole`` if no high byte beside it is left over."""

    how: str
    start: int
    end: int
    new: np.ndarray
    whole: bool
    drop: float = 0.0


def _points(b: bytes, enc: str) -> np.ndarray:
    return np.frombuffer(b.decode(enc).encode("utf-32-le"), np.uint32)


def _run_repairs(flat: np.ndarray) -> list[Part]:
    """Runs of flat code points that strictly decode as a multi-byte encoding."""
    out, clip = [], np.minimum(flat, _POINTS - 1)
    pairs = _high_pairs(clip)
    for enc in dict.fromkeys(INTO_UTF8 + INTO_GBK):
        table = byte_table(enc)
        high = lambda i: bool(0 <= i < len(clip) and table[clip[i]] >= 0x80)  # noqa: B023, E731
        if enc in INTO_UTF8:
            for s, e, b in _matches(_UTF8, clip, pairs, enc):
                new, whole = _points(b, "utf-8"), not (high(s - 1) or high(e))
                out.append(Part(f"{enc}>utf-8", s, e, new, whole))
                for again in range(2, LAYERS + 1):  # nested layers of the same kind within the run
                    inner = table[np.minimum(new, _POINTS - 1)].tobytes()
                    if not _UTF8.fullmatch(inner):
                        break
                    new = _points(inner, "utf-8")
                    out.append(Part(f"{enc}>utf-8 x{again}", s, e, new, whole))
        if enc in INTO_GBK:
            for first, last, _ in _matches(_GBK, clip, pairs, enc):
                # an odd byte at either end may be the one that stands apart
                for s, e in [(first, last)] + [(first + 1, last + 1)] * high(last):
                    b = table[clip[s:e]].tobytes()
                    at_ = 0
                    while at_ < len(b):
                        try:
                            z = len(b)
                            new = _points(b[at_:], "gbk")
                        except UnicodeDecodeError as x:
                            z = at_ + x.start
                            new = _points(b[at_:z], "gbk")
                        if z - at_ >= 4:
                            out.append(Part(f"{enc}>gbk", s + at_, s + z, new, not (high(s + at_ - 1) or high(s + z))))
                        at_ = z + 2
    b, at_ = gbk_bytes(flat)
    raw = np.frombuffer(b, np.uint8)
    begins = np.zeros(len(raw) + 1, bool)
    begins[at_] = True
    begins[:-1] &= (raw & 0xC0) != 0x80  # where a character begins on either reading
    for s, e in _utf8_in_gbk(_UTF8_IN_GBK, b):
        k = np.flatnonzero(begins[s : e + 1])
        if e < len(raw) and not begins[e] and e in at_[np.searchsorted(at_, e) : np.searchsorted(at_, e) + 1]:
            k = np.append(k, e - s)  # the run ends with a character, though what follows begins with a byte that goes on
        if len(k) > 1:
            i, j = np.searchsorted(at_, (s + k[0], s + k[-1]))
            beside = (s + k[0] > 0 and raw[s + k[0] - 1] >= 0xE0 and s + k[0] > s) or k[-1] < e - s
            out.append(Part("gbk>utf-8", int(i), int(j), _points(b[s + k[0] : s + k[-1]], "utf-8"), not beside))
    return [p for p in out if np.array_equal(_garbled(p), flat[p.start : p.end])]


def _garbled(p: Part) -> np.ndarray:
    """The repair of a part garbled again, to be compared with what stands there."""
    read_in, _, meant = p.how.partition(">")
    meant, _, times = meant.partition(" x")
    now = p.new
    for _ in range(int(times or 1)):
        b = now.astype(np.uint32).tobytes().decode("utf-32-le").encode(meant)
        now = _points(b, "gbk") if read_in == "gbk" else char_table(read_in)[np.frombuffer(b, np.uint8)]
    return now


def _span_repairs(flat: np.ndarray, off: np.ndarray, model: Model) -> list[Part]:
    """Spans between two encodings whose characters correspond one to one: of each rise of the summed drop in a text its best part."""
    here = np.minimum(flat, _POINTS - 1)
    high = here >= 0x80
    touched = high.copy()
    touched[1:] |= high[:-1]
    place = np.flatnonzero(touched)  # nothing changes elsewhere
    if not len(place):
        return []
    row = np.searchsorted(off, place, side="right") - 1
    now = here[place]
    prev = np.where(place > off[row], here[place - 1], 10)
    base = model.cost(prev, now)
    out = []
    for read_in, meant in ONE_TO_ONE:
        table = swap_table(read_in, meant)
        as_meant = lambda x: np.where(table[x] > 0, table[x], x)  # noqa: B023, E731
        new = as_meant(now)
        moved = new != now
        if not moved.any():
            continue
        dead = table[now] == 0
        new_prev = as_meant(prev)
        gain = np.zeros(len(place))
        k = np.flatnonzero(moved | (new_prev != prev))
        gain[k] = base[k] - model.cost(new_prev[k], new[k])
        gain[dead] = -1e3
        total = np.cumsum(gain) - row * 1e7
        shifted = total - gain  # sums before each place, apart by rows
        low = np.minimum.accumulate(shifted)
        best = total - low
        some = np.flatnonzero(best > TAKE_SPAN)
        if not len(some):
            continue
        rise = np.cumsum(shifted <= low)  # a new low begins another rise
        _, at_ = np.unique(rise[some], return_index=True)
        for group in np.split(some, at_[1:]):
            end = int(group[np.argmax(best[group])])
            start = int(np.searchsorted(rise, rise[end]))
            # pairs of garbled characters are likely once one is there: the new characters must be more usual by themselves, too
            k = start + np.flatnonzero(moved[start : end + 1])
            if len(k) and np.log((model.ones[np.minimum(new[k], _POINTS - 1)] + 1) / (model.ones[now[k]] + 1)).sum() > 0:
                s, e = int(place[k[0]]), int(place[k[-1]]) + 1
                out.append(Part(f"{read_in}>{meant}", s, e, as_meant(here[s:e]).astype(np.uint32), True))
    return out


def _drops(flat: np.ndarray, parts: list[Part], model: Model) -> None:
    """Set how far the cost drops by each part, in its place: after the character before it and with the one after it."""
    if not parts:
        return
    pad = np.append(flat, np.uint32(10)).astype(np.uint32)
    lead = lambda p: pad[p.start - 1 : p.start] if p.start else np.array([10], np.uint32)

    def costs(middles: list[np.ndarray]) -> np.ndarray:
        strings = [np.concatenate([lead(p), x, pad[p.end : p.end + 1]]) for p, x in zip(parts, middles)]
        ends = np.cumsum([len(x) for x in strings])
        all_ = np.concatenate(strings)
        c = np.zeros(len(all_) + 1)
        c[2:] = model.cost(all_[:-1], all_[1:])
        c[1 + np.append(0, ends[:-1])] = 0
        return np.add.reduceat(c[1:], np.append(0, ends[:-1]))

    for p, d in zip(parts, costs([flat[p.start : p.end] for p in parts]) - costs([p.new for p in parts])):
        p.drop = float(d)


def repair_layer(texts: list[str], model: Model) -> list[tuple[str, list[str], bool]]:
    """One layer undone: each text, the repairs taken in it, and whether none of them left a byte beside it."""
    plain, off0 = at.to_codepoints(pa.array(texts, pa.string()))
    flat = np.insert(plain, off0[1:], 10)
    off = off0 + np.arange(len(off0))
    runs = _run_repairs(flat)
    _drops(flat, runs, model)
    by: dict[int, dict[str, list[Part]]] = {}
    rows = np.searchsorted(off, [p.start for p in runs], side="right") - 1
    for r, p in zip(rows, runs):
        if p.drop > 0:
            by.setdefault(int(r), {}).setdefault(p.how, []).append(p)
    # the runs of one encoding in a text bear each other out
    by = {r: some for r, x in by.items() if (some := {how: ps for how, ps in x.items() if sum(p.drop for p in ps) >= TAKE_RUN})}
    spans = _span_repairs(flat, off, model)
    _drops(flat, spans, model)
    for r, p in zip(np.searchsorted(off, [p.start for p in spans], side="right") - 1, spans):
        if p.drop >= TAKE_SPAN:
            by.setdefault(int(r), {}).setdefault(p.how, []).append(p)
    out = []
    for r, t in enumerate(texts):
        # the part that explains most comes first, others where they don't overlap; in doubt the encoding that explains most of the text
        total = {how: sum(p.drop for p in ps) for how, ps in by.get(r, {}).items()}
        main = max(total, key=total.get, default="")
        taken: list[Part] = []
        for p in sorted((p for ps in by.get(r, {}).values() for p in ps), key=lambda p: -p.drop - IN_DOUBT * (p.how == main)):
            if not _overlaps(p, taken):
                bisect.insort(taken, p, key=lambda q: q.start)
        if taken:
            pieces, at_ = [], int(off[r])
            for p in taken:
                pieces += [flat[at_ : p.start], p.new]
                at_ = p.end
            t = np.concatenate([*pieces, flat[at_ : off[r + 1] - 1]]).astype(np.uint32).tobytes().decode("utf-32-le")
        out.append((t, list(dict.fromkeys(p.how for p in taken)), all(p.whole for p in taken)))
    return out


def _overlaps(p: Part, ordered: list[Part]) -> bool:
    i = bisect.bisect_left(ordered, p.end, key=lambda q: q.start)
    return i > 0 and ordered[i - 1].end > p.start


def repair(texts: list[str], model: Model) -> list[tuple[str, list[str], bool]]:
    """Repairs repeated until no cost drops: nested layers, and stretches that come to light with others."""
    now, steps, whole = list(texts), [[] for _ in texts], [True] * len(texts)
    open_ = list(range(len(texts)))
    while open_:  # every round lowers the cost of what stays open
        more = []
        for i, (t, taken, ok) in zip(open_, repair_layer([now[i] for i in open_], model)):
            if taken and t != now[i]:
                now[i], whole[i] = t, whole[i] and ok
                steps[i] += taken
                more.append(i)
        open_ = more
    return list(zip(now, steps, whole))


def restored(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """(key, restored, repairs, complete): every garbled text with what could be restored.

    ``complete`` is false if lost characters (U+FFFD), stray controls or bytes beside a
    restored run remain.
    """
    model = model or character_model(df, text)
    shared = df.sparkSession.sparkContext.broadcast(model)  # tables of fixed size
    schema = f"{key} {df.schema[key].dataType.simpleString()}, restored string, repairs array<string>, complete boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, [text]):
                cps, off = at.to_codepoints(b.column(text))
                rows = np.unique(np.searchsorted(off, np.flatnonzero(cps >= 0x80), side="right") - 1)
                if not len(rows):
                    continue
                pick = pa.array(rows)
                texts = b.column(text).take(pick).to_pylist()
                got = repair(texts, shared.value)
                keep = [i for i, (t, steps, _) in enumerate(got) if steps or "�" in t or any("\x80" <= c < "\xa0" for c in t)]
                if keep:
                    out = [got[i] for i in keep]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(key).take(pick).take(pa.array(keep)), pa.array([t for t, _, _ in out], pa.string()), pa.array([s for _, s, _ in out], pa.list_(pa.string())), pa.array([whole and not re.search("[�\x80-\x9f]", t) for t, _, whole in out])],
                        [key, "restored", "repairs", "complete"],
                    )

    return df.select(key, text).mapInArrow(run, schema)
