"""Personal information inside free text (problem 4).

Method: skip-chain conditional random field.  The nodes are the mentions of a text
that could be personal: words, runs of digits, mail addresses, street addresses.
Each has potentials from its shape, its affixes and the words around it;
neighbours are joined by chain potentials, and distant mentions of the same word
by skip potentials, so that loopy message passing makes a document label them
alike.  Labels are EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME and none.

Training is piecewise: unary weights by multinomial logistic regression, pair
potentials from label frequencies.  There are no labelled rows.  Sentences made by
rule of common names carry exact labels; rows of the corpus get theirs from plain
cues ("my name is", "call", "地址："), and words that cues often mark as names are
names at their other mentions, too, so that the field learns the contexts of this
corpus and not those of the cues.  The training sample is bounded by ``SAMPLE``
rows, chosen by hash; detection reads every text whole.

Words written in Latin letters are mentions one by one, chained where they follow
each other; every stretch of Han characters that begins with a family name is one
with a given name of one and one with two characters, of which the likelier stays.

Texts are read in reading form; spans are traced back, so that everything around
a placeholder stays as it was.

Defined results: null stays null; empty and clean texts come back unchanged;
texts of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from . import names
from . import words as w
from .reading import traced
from .workspace import slices

LABELS = ("none", "email", "phone", "id_number", "address", "name")
NONE, EMAIL, PHONE, ID, ADDRESS, NAME = range(6)
#: Rows of the training sample (bounded, whatever the tables' sizes).
SAMPLE = 40_000
#: Labelled mentions of that sample that a field is fitted on, and three times as many of plain words.
MENTIONS = 60_000
FEATURE_BITS = 18
ROUNDS = 4
#: Words whose affixes and neighbours alone speak against a name by more than this at every mention in a text are left out of the field.
FIRST_PASS = -2.0
_F = 16
#: Weight of a mention in a sentence made by rule.
EXACT = 6.0
#: Weight of a Han stretch of the corpus that no cue marks.
OPEN = 0.15

# Compound family names written with two characters, and common ones with one.
COMPOUND = "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于 司空 闾丘 子车 亓官 司寇 巫马 公西 颛孙 壤驷 公良 漆雕 乐正 宰父 谷梁 拓跋 夹谷 轩辕 令狐 段干 百里 呼延 东郭 南门 羊舌 微生 公户 公玉 梁丘 左丘 东门 西门 第五".split()
SINGLE = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
# Words for streets.
STREET_AFTER = "street st avenue ave road rd lane ln drive dr close way court ct boulevard blvd terrace crescent place square row walk grove gardens hill mews parade highway hwy".split()
STREET_BEFORE = "rue avenue av boulevard bd place chemin allée impasse quai route cours passage square sentier calle avda avenida plaza paseo camino carrera ronda travesía carretera via piazza".split()
STREET_ENDING = "straße strasse weg gasse allee platz ring ufer damm steig".split()

# Cues that label the training rows. {N} stands for a name.
_NAME = r"[^\W\d_]+(?:-[^\W\d_]+)?(?: [^\W\d_]\.)?(?: [^\W\d_]{3,}(?:-[^\W\d_]+)?)?"
NAME_CUES = [
    r"\b(?:my name is|i'm|i am|contact person:|signed,|dear|cheers,|regards,|dr\.|mr\.|mrs\.|ms\.|me llamo|je m'appelle|ich heiße|ansprechpartner:|frau|herr|señor|señora|monsieur|madame)\s+({N})(?=[.,;:!?\n]|\s*$|\s{2}|\s+[^\W\d_A-ZÀ-Þ]+\b)",
    r"\b(?:talk to|i met|thanks to|the landlord,|as dr\.|hablar con|voir avec)\s+({N})(?=\s+(?:first|for|antes|hat|said|please)\b|[.,;\n]|\s*$|\s{2})",
    r"(?:^|[.!?\n]\s*)({N}) (?:approved the|said, wait|hat zugesagt)",
]
HAN_CUES = [r"(?:我叫|名叫|先找|姓名[：:]|联系人[：:]|我同事)([一-鿿]{2,4}?)(?=[。，,.！!？?\s]|确认|负责|老师|$)", r"(?:^|[。！？\n])([一-鿿]{3,4})老师已经"]
PHONE_CUE = re.compile(r"(?:\b(?:tel|tél|phone|mobile|call|text me on|my number is|joignable au|rückruf unter|llamar al|móvil|teléfono|telefon|fax)\b\.?\s*:?\s*|电话[：:]?|手机[：:]?|打)$", re.I)
PHONE_AFTER = re.compile(r"^\s?(?:\(mobile\)|找我|after lunch)", re.I)
ID_CUE = re.compile(r"(?:passport/id|national id:|id number|ssn/ni no\.|registered with|identity number|d'identité(?: n°| :|:)?|dni/nie|documento de identidad:|ausweisnummer|ausweis-nr\.:|身份证是|身份证号|身份证：|证件号码：|证件号码:)\s*$", re.I)
ID_AFTER = re.compile(r"^\s?(?:is on file|expires soon|was used for|as identity)", re.I)
ADDRESS_CUE = re.compile(r"(?:\b(?:address|i live at|ship it to|meet at|moved to|adresse|lieferung an|livrer au|entregar en|dirección|wohne in|habite au|vivo en)\s?:?\s*|地址：|地址:|住在|寄到|送到)$", re.I)


def _hash(s: str) -> int:
    b = s.encode("utf-8", "replace")
    return zlib.crc32(b) << 32 | zlib.crc32(b, 7)


_AT = re.compile(r"@|[(\[{]at[)\]}]", re.I)
_LEFT = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*\s?$")
_RIGHT = re.compile(r"\s?[A-Za-z0-9\-]+(?:(?:\.|\s?[(\[{]dot[)\]}]\s?)[A-Za-z0-9\-]+)*(?:\.|\s?[(\[{]dot[)\]}]\s?)[A-Za-z][A-Za-z0-9\-]*", re.I)
_DIGITS = re.compile(r"\d(?:(?:[ ()/\-]{1,3}|\.)?\d){5,24}[Xx]?")
_SPACED_DATE = re.compile(r"(?:\d{4}-\d\d-\d\d)(?:[ .]|$)")
_TAIL = re.compile(r" ?[A-Za-z](?![A-Za-z0-9])")
_LEADS = {6: re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2} ?$"), 7: re.compile(r"(?<![A-Za-z0-9])[A-Za-z]-?$")}
_HAN_STREET = re.compile(r"[路街巷弄道]\d{1,5}(?:号|弄)(?:\d{1,5}(?:号楼|栋|幢|单元|室|层|楼|号))*")
_H = "(?:(?![到在于是住寄送址往])[一-鿿])"
_HAN_PLACE = re.compile(f"(?:{_H}{{2,3}}省)?(?:{_H}{{2,4}}市)?(?:{_H}{{2,3}}[区县镇])?{_H}{{1,4}}$")
# a street with its number before it: read back from the word for the street, then on to flat, town and code
_NUM_BACK = re.compile(r"(?:(?:flat|apt\.?|unit|suite) \w{1,5}, )?(?<![\w.\-])\d{1,5}[a-z]?(?: bis| ter)?,? (?:[^\W\d_][\w'’\-]*\.? ){0,2}$", re.I)
_STREET_ON = re.compile(r"(?:\.(?=,|[ ][^\W\d_]+(?:[.,\n]|\s{2}|$| \d{5}\b(?! \d))))?(?:, (?:flat|apt\.?|unit|suite) \w{1,5})?(?:,? (?!(?:on|last|when|next|after|at|in|and|the|is|was)\b)[^\W\d_]+|\n ?[^\W\d_]+(?=\s*\n|\.| \d{5}))?(?: \d{4,5}(?![\d-]))?", re.I)
# a street word with its name after it, and the number on either side
_NAMED_ON = re.compile(r"(?:(?<=av)\.|(?<=bd)\.|(?<=blvd)\.|(?<=avda)\.)? ((?:(?:de la|de los|de las|del|de|des|du|la|le|les) |de l'|l'|d'))?([^\W\d_])[\w'’\-]*(?: [^\W\d_][\w\-]*)?(,? (?:nº |n° |n\.º )?\d{1,5}[a-z]?(?:,? \d{1,2}º \w)?)?(?:, \d{4,5} [^\W\d_]+)?", re.I)
_NUM_BEFORE = re.compile(r"(?<![\w.\-])\d{1,5}(?: bis| ter)?,? $", re.I)
_HOUSE = re.compile(r"[^\W\d_] \d{1,3}[a-z]?\b(?:, \d{5} [^\W\d_]+)?", re.I)
_ENDING = re.compile(r"\b[^\W\d_][\w\-]*(?:" + "|".join(STREET_ENDING) + ")$", re.I)
_CALLE = re.compile(r"\b[Cc]/")
_STREET_WORD = re.compile(r"\b(?:" + "|".join(STREET_AFTER + STREET_BEFORE) + r")\b", re.I)


@dataclass
class Nodes:
    """Mentions in order of place: spans in the flat text, and hashed features."""

    start: np.ndarray
    end: np.ndarray
    word: np.ndarray
    feats: np.ndarray
    kind: np.ndarray


def _valid_date(digits: str) -> bool:
    return digits[:2] in ("19", "20") and "01" <= digits[2:4] <= "12" and "01" <= digits[4:6] <= "31" if len(digits) == 6 else len(digits) == 8 and digits[:2] in ("18", "19", "20") and "01" <= digits[4:6] <= "12" and "01" <= digits[6:8] <= "31"


def spans(text: str, streets: list[tuple[int, int, bool]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of mail addresses, runs of digits and street addresses that could be personal; ``streets``: (start, end, number first) of words for streets."""
    out: list[tuple[int, int, int]] = []
    for m in _AT.finditer(text):
        left = _LEFT.search(text, max(0, m.start() - 80), m.start())
        right = _RIGHT.match(text, m.end())
        if left and right:
            out.append((left.start(), right.end(), EMAIL))
    for m in _HAN_STREET.finditer(text):
        lead = _HAN_PLACE.search(text, max(0, m.start() - 14), m.start())
        out.append((lead.start() if lead else m.start(), m.end(), ADDRESS))
    for s, e, first in streets:
        if first:
            if m := _NUM_BACK.search(text, max(0, s - 48), s):
                out.append((m.start(), _STREET_ON.match(text, e).end(), ADDRESS))
        elif m := _NAMED_ON.match(text, e):
            lead = _NUM_BEFORE.search(text, max(0, s - 12), s)
            # a name without an article is written with a capital
            if (lead or m.group(3)) and (m.group(1) or m.group(2).isupper()):
                out.append((lead.start() if lead else s, m.end(), ADDRESS))
    for c in _CALLE.finditer(text):
        if (m := _NAMED_ON.match(text, c.end())) and m.group(3):
            out.append((c.start(), m.end(), ADDRESS))
    for m in _HOUSE.finditer(text):
        if text[m.start()] in "eEgGzZrRmM" and (lead := _ENDING.search(text, max(0, m.start() - 40), m.start() + 1)) and lead.group()[0].isupper():
            out.append((lead.start(), m.end(), ADDRESS))
    for m in _DIGITS.finditer(text):
        s, e = m.start(), m.end()
        d = _SPACED_DATE.match(text, s, e)
        while d and d.end() < e:  # a date before the run
            s = d.end()
            while s < e and not (text[s].isdigit() or text[s] in "(+"):
                s += 1
            d = _SPACED_DATE.match(text, s, e)
        if d or sum(c.isdigit() for c in text[s:e]) < 6:
            continue
        while s > 0 and text[s - 1] in "+(":
            s -= 1
        # identity numbers of letters and digits: two letters, 6 digits, a letter; or one letter, 7 digits, a letter; or 8 digits and a letter
        count = sum(c.isdigit() for c in text[s:e])
        tail = _TAIL.match(text, e) if count in (6, 7, 8) and text[e - 1].isdigit() else None
        lead = _LEADS[count].search(text, max(0, s - 4), s) if tail and count < 8 else None
        if tail and (lead or count == 8):
            s, e = lead.start() if lead else s, tail.end()
        elif count < 7:
            continue
        if s and (text[s - 1].isalnum() and ord(text[s - 1]) < 0x3000 or text[s - 1] in "@.-_/=" and text[s] not in "(+") or e < len(text) and text[e].isalnum() and ord(text[e]) < 0x3000:
            continue
        out.append((s, e, PHONE))
    out.sort(key=lambda x: (x[0], -(x[1])))
    kept: list[tuple[int, int, int]] = []
    for x in out:
        if kept and x[0] < kept[-1][1]:
            if x[2] == PHONE or kept[-1][2] != PHONE:
                continue
            kept.pop()
        kept.append(x)
    return kept


def _feature(kind: int, values: np.ndarray) -> np.ndarray:
    return (w.mix(values.astype(np.uint64) ^ w.mix(np.array([kind], np.uint64))) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)


def _stretch_hash(cps: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of stretches of at most four characters."""
    out = np.zeros(len(s), np.uint64)
    for d in range(4):
        out = w.mix(out + np.where(s + d < e, cps[np.minimum(s + d, max(0, len(cps) - 1))] if len(cps) else 0, 0).astype(np.uint64))
    return out


def _text_feature(kind: int, value: str) -> int:
    return zlib.crc32(f"{kind} {value}".encode("utf-8", "replace")) & ((1 << FEATURE_BITS) - 1)


@dataclass
class Field:
    """A trained field: unary weights, pair potentials, and the threshold of the first pass over words."""

    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray




def _word_keys(words: list[str]) -> np.ndarray:
    cps, off = at.to_codepoints(pa.array(words))
    return np.sort(w.word_hashes(cps, off[:-1], off[1:]))


_STREET_KEYS = _word_keys(STREET_AFTER), _word_keys(STREET_BEFORE)
_COMPOUND_KEYS = np.sort(np.array([ord(c[0]) << 21 | ord(c[1]) for c in COMPOUND], np.int64))
_GIVEN_KEYS = _word_keys(names.GIVEN)


def _is_han(c: np.ndarray) -> np.ndarray:
    return (c >= 0x4E00) & (c < 0xA000)


_HAN_KINDS = _feature(47, np.array([f * 4 + m for f in (1, 2) for m in (1, 2)]))


def han_names(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, features) of stretches that begin with a family name, with one and with two characters more."""
    pad = np.concatenate([[0, 0], cps, [0] * 6]).astype(np.int64)
    at_ = lambda k: pad[k + 2]
    s = np.flatnonzero(np.isin(cps, [ord(c) for c in SINGLE]))
    double = np.flatnonzero(np.isin(pad[2:-7] << 21 | pad[3:-6], _COMPOUND_KEYS)) if len(cps) else s
    starts = np.concatenate([s, s, double, double])
    family = np.repeat([1, 1, 2, 2], [len(s), len(s), len(double), len(double)])
    more = np.repeat([1, 2, 1, 2], [len(s), len(s), len(double), len(double)])
    ends = starts + family + more
    whole = np.ones(len(starts), bool)
    for d in (1, 2, 3):
        whole &= (starts + d >= ends) | _is_han(at_(starts + d))
    starts, ends, family, more = starts[whole], ends[whole], family[whole], more[whole]
    first, last = at_(starts + family), at_(ends - 1)
    rank = lambda c: np.where(np.isin(c, [ord(x) for x in names.HAN_GIVEN]), 2, np.where(np.isin(c, [ord(x) for x in names.HAN_OTHER]), 1, 0))
    usual = rank(first) * 3 + rank(last)
    prev, prev2, nxt, nxt2 = at_(starts - 1), at_(starts - 2), at_(ends), at_(ends + 1)
    surname = at_(starts) * 4 + family
    kind = family * 4 + more
    edge = lambda c: np.where(_is_han(c), 1, np.where(c < 0x80, 2, 3))
    cols = [surname, first, last * 4 + more, prev, nxt, prev2 << 21 | prev, nxt << 21 | nxt2, kind, kind * 16 + usual, edge(prev) * 4 + edge(nxt), first << 21 | last, surname << 21 | first, nxt * 16 + kind, prev * 16 + kind, usual * 16 + edge(prev) * 4 + edge(nxt), usual]
    return starts, ends, np.stack([_feature(40 + j, c) for j, c in enumerate(cols)], axis=1) if len(starts) else np.empty((0, _F), np.int32)


def nodes(cps: np.ndarray, off: np.ndarray, text: str, field: Field | None) -> Nodes:
    """All mentions of the flat text; with a field, words that can't be names by their affixes and neighbours at any mention in their text are left out."""
    ws, we, row = w.word_spans(cps, off)
    empty = Nodes(*(np.empty(0, np.int64) for _ in range(2)), np.empty(0, np.uint64), np.empty((0, _F), np.int32), np.empty(0, np.int64))
    if not len(ws):
        return empty
    h = w.word_hashes(cps, ws, we)
    n = len(ws)
    low, size = w._tables()[1], we - ws
    c = low[cps]
    at_ = lambda k: np.where(k < we, c[np.minimum(k, len(c) - 1)], 0).astype(np.uint64)
    back = lambda k: np.where(we - k >= ws, c[np.maximum(we - k, 0)], 0).astype(np.uint64)
    around = lambda d: np.where((np.arange(n) + d >= 0) & (np.arange(n) + d < n), np.take(h, np.clip(np.arange(n) + d, 0, n - 1)), 0) * (np.take(row, np.clip(np.arange(n) + d, 0, n - 1)) == row)
    latin = (size >= 2) & (cps[ws] < 0x2000) & (cps[ws] >= 0x41) & ~((cps[ws] >= 0x30) & (cps[ws] < 0x3A))
    i = np.flatnonzero(latin)
    pre = at_(ws) | at_(ws + 1) << np.uint64(21) | at_(ws + 2) << np.uint64(42)
    suf = back(1) | back(2) << np.uint64(21) | back(3) << np.uint64(42)
    p1, n1 = around(-1), around(1)
    # what is known of the word and its neighbours: a common given name, a capital; neighbours after one blank or hyphen
    upper = cps[ws] != c[ws]
    known = np.isin(h, _GIVEN_KEYS).astype(np.uint64) * np.uint64(2) + upper
    beside = np.zeros(n, bool)
    beside[1:] = (ws[1:] - we[:-1] == 1) & (row[1:] == row[:-1]) & np.isin(cps[we[:-1]], (32, 45))
    before_it = np.zeros(n, np.uint64)
    before_it[1:] = np.where(beside[1:], known[:-1] + np.uint64(1), 0)
    after_it = np.zeros(n, np.uint64)
    after_it[:-1] = np.where(beside[1:], known[1:] + np.uint64(1), 0)
    f_known = _feature(15, known * np.uint64(64) + before_it * np.uint64(8) + after_it)
    f_word, f_pre, f_suf, f_prev, f_next, f_given = (_feature(k, v) for k, v in ((1, h), (2, pre), (3, suf), (4, p1), (5, n1), (16, known)))
    if field is not None:
        wt = field.weights
        quick = sum(wt[f[i], NAME] - wt[f[i], NONE] for f in (f_word, f_pre, f_suf, f_prev, f_next, f_known, f_given))
        # by word and text: one good mention keeps the others, which skip edges may then label
        key = h[i] ^ w.mix(row[i].astype(np.uint64))
        some = np.zeros(n, bool)
        some[i[np.isin(key, key[quick > FIRST_PASS])]] = True
        # and so are words with a capital beside one, which may be the rest of its name
        beside &= upper & np.append(False, upper[:-1])
        for _ in range(2):
            some[1:] |= some[:-1] & beside[1:]
            some[:-1] |= some[1:] & beside[1:]
        i = np.flatnonzero(some & latin)
    p2, n2 = around(-2), around(2)
    before = np.where(ws > 0, cps[np.maximum(ws - 1, 0)], 0) + (np.where(ws > 1, cps[np.maximum(ws - 2, 0)], 0).astype(np.int64) << 21)
    after = np.where(we < len(cps), cps[np.minimum(we, len(cps) - 1)], 0)
    second = cps[np.minimum(ws + 1, len(cps) - 1)] != c[np.minimum(ws + 1, len(cps) - 1)]
    shape = upper.astype(np.uint64) * np.uint64(2) + second.astype(np.uint64)
    suf4 = suf ^ w.mix(back(4))
    feats = [f_word, f_pre, f_suf, f_prev, f_next]
    cols = [f[i] for f in feats] + [_feature(6, p2[i]), _feature(7, n2[i]), _feature(8, before[i].astype(np.uint64)), _feature(9, after[i].astype(np.uint64)), _feature(10, shape[i]), _feature(11, suf4[i]), _feature(12, p1[i] ^ w.mix(p2[i])), _feature(13, n1[i] ^ w.mix(n2[i])), _feature(14, shape[i] * 0), f_known[i], f_given[i]]
    parts = [(ws[i], we[i], h[i], np.stack(cols, axis=1), np.full(len(i), NAME))]
    hs, he, hf = han_names(cps)
    if field is not None and len(hs):
        score = sum(field.weights[hf[:, j], NAME] - field.weights[hf[:, j], NONE] for j in range(_F))
        hw = _stretch_hash(cps, hs, he) ^ w.mix(np.searchsorted(off, hs, side="right").astype(np.uint64))
        k = np.isin(hw, hw[score > FIRST_PASS])
        hs, he, hf = hs[k], he[k], hf[k]
    parts.append((hs, he, _stretch_hash(cps, hs, he), hf, np.full(len(hs), NAME)))
    special: list[tuple[int, int, int]] = []
    is_after = np.isin(h, _STREET_KEYS[0])
    street = np.flatnonzero(is_after | np.isin(h, _STREET_KEYS[1]))
    special += spans(text, list(zip(ws[street].tolist(), we[street].tolist(), is_after[street].tolist())))
    if special:
        rows_ = []
        for s, e, k in special:
            x = text[s:e]
            left, right = text[max(0, s - 24) : s], text[e : e + 12]
            lw = re.findall(r"[^\W\d_]+|[^\w\s]", left.lower())
            rw = re.findall(r"[^\W\d_]+|[^\w\s]", right.lower())
            lh = left.rstrip()[-2:] if left and ord(left.rstrip()[-1:] or " ") > 0x2E80 else " ".join(lw[-2:])
            shape_ = re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "0", x)) if k == PHONE else ""
            digits = re.sub(r"\D", "", x)
            valid = k == PHONE and (len(digits) in (17, 18) and _valid_date(digits[6:14]) and digits[0] != "0")
            street = _STREET_WORD.search(x) if k == ADDRESS else None
            rows_.append(
                [_text_feature(20, x.lower() if k == NAME else ""), _text_feature(21, shape_), _text_feature(22, str(len(digits)) if k == PHONE else ""), _text_feature(23, lw[-1] if lw else ""), _text_feature(24, rw[0] if rw else ""), _text_feature(25, lh), _text_feature(26, right[:2] if ord(right[:1] or " ") > 0x2E80 else " ".join(rw[:2])), _text_feature(27, str(k)), _text_feature(28, street.group().lower() if street else ""), _text_feature(29, f"{k}{valid}"), _text_feature(30, x[:1] if k == PHONE and not x[0].isdigit() else ""), _text_feature(31, x[:2] if k == NAME else ""), _text_feature(32, f"{shape_} {lw[-1] if lw else ''}"), *[_text_feature(33 + j, str(k)) for j in range(3)]]
            )
        s, e, k = (np.array(v, np.int64) for v in zip(*special))
        parts.append((s, e, np.array([_hash(text[a:b].lower()) for a, b, _ in special], np.uint64), np.array(rows_, np.int32), k))
    start, end, word, feat, kind = (np.concatenate([p[j] for p in parts]) for j in range(5))
    # words inside another mention give way to it
    cover = np.zeros(len(cps) + 1, np.int32)
    big = kind != NAME
    np.add.at(cover, start[big], 1)
    np.add.at(cover, end[big], -1)
    inside = np.cumsum(cover)[start] > 0
    keep = big | ~inside if field is not None else np.ones(len(big), bool)  # in training, words of an address are examples of none
    order = np.argsort(start[keep], kind="stable")
    return Nodes(start[keep][order], end[keep][order], word[keep][order], feat[keep][order], kind[keep][order])


def edges(nd: Nodes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges between neighbours, and skip edges between a word and its next mention in the same document."""
    n = len(nd.start)
    row = np.searchsorted(off, nd.start, side="right") - 1
    a = np.arange(n - 1) if n else np.empty(0, np.int64)
    near = (row[1:] == row[:-1]) & (nd.start[1:] - nd.end[:-1] <= 4) if n else np.empty(0, bool)
    chain = np.stack([a[near], a[near] + 1], axis=1) if n else np.empty((0, 2), np.int64)
    order = np.lexsort((nd.start, nd.word, row))
    same = (row[order][1:] == row[order][:-1]) & (nd.word[order][1:] == nd.word[order][:-1]) if n else np.empty(0, bool)
    skip = np.stack([order[:-1][same], order[1:][same]], axis=1) if n else np.empty((0, 2), np.int64)
    return chain, skip


def infer(nd: Nodes, off: np.ndarray, field: Field) -> np.ndarray:
    """Labels by loopy max-product message passing over chain and skip edges; of names that overlap the likelier stays."""
    unary = np.zeros((len(nd.feats), len(LABELS)), np.float32)
    for j in range(_F):
        unary += field.weights[nd.feats[:, j]]
    # a mention is of its own kind or none; a run of digits may be a phone or an identity number
    allow = np.zeros((len(LABELS), len(LABELS)), bool)
    allow[:, NONE] = True
    for k in range(1, len(LABELS)):
        allow[k, k] = True
    allow[PHONE, ID] = True
    unary = np.where(allow[nd.kind], unary, -30.0)
    chain, skip = edges(nd, off)
    if not len(chain) and not len(skip):
        return _apart_names(nd, unary)
    e = np.concatenate([chain, skip])
    pot = np.concatenate([np.broadcast_to(field.chain, (len(chain), *field.chain.shape)), np.broadcast_to(field.skip, (len(skip), *field.skip.shape))])
    fwd, bwd = np.zeros((len(e), len(LABELS))), np.zeros((len(e), len(LABELS)))

    def gathered() -> np.ndarray:
        into, of = np.concatenate([e[:, 1], e[:, 0]]), np.concatenate([fwd, bwd])
        return unary + np.stack([np.bincount(into, of[:, c], len(unary)) for c in range(len(LABELS))], axis=1)

    for _ in range(ROUNDS):
        belief = gathered()
        new_f = ((belief[e[:, 0]] - bwd)[:, :, None] + pot).max(axis=1)
        new_b = ((belief[e[:, 1]] - fwd)[:, None, :] + pot).max(axis=2)
        fwd, bwd = new_f - new_f.max(axis=1, keepdims=True), new_b - new_b.max(axis=1, keepdims=True)
    return _apart_names(nd, gathered())


def _apart_names(nd: Nodes, belief: np.ndarray) -> np.ndarray:
    label = belief.argmax(axis=1)
    margin = belief[:, NAME] - belief[:, NONE]
    hit = np.flatnonzero(label == NAME)
    hit = hit[np.argsort(nd.start[hit], kind="stable")]
    near = np.flatnonzero(nd.start[hit][1:] < nd.end[hit][:-1]) if len(hit) else hit
    if len(near):
        taken: dict[int, int] = {}
        group = np.unique(np.concatenate([hit[near], hit[near + 1]]))
        for i in group[np.argsort(-margin[group], kind="stable")].tolist():
            span = range(int(nd.start[i]), int(nd.end[i]))
            if any(x in taken for x in span):
                label[i] = NONE
            else:
                taken.update(dict.fromkeys(span, i))
    return label


_CUES = [re.compile(c.replace("{N}", _NAME), re.I | re.M) for c in NAME_CUES + HAN_CUES]
UNKNOWN = -1


def cued_names(text: str) -> list[tuple[int, int]]:
    """Places that plain cues mark as names."""
    return [m.span(1) for p in _CUES for m in p.finditer(text)]


def cued_labels(text: str, nd: Nodes, places: list[tuple[int, int]]) -> np.ndarray:
    """Training labels of mentions: names at ``places``, the others from plain cues around them."""
    out = np.zeros(len(nd.start), np.int64)
    named = np.zeros(len(text) + 1, bool)
    exact = set(places)
    for s, e in places:
        named[s:e] = True
    first = np.frombuffer(text.encode("utf-32-le"), np.uint32)[nd.start] if len(nd.start) else np.empty(0, np.uint32)
    name, han = nd.kind == NAME, _is_han(first)
    out[name & ~han & named[nd.start] & (nd.end - nd.start > 1)] = NAME
    for j in np.flatnonzero(name & han & named[nd.start]).tolist():
        out[j] = NAME if (int(nd.start[j]), int(nd.end[j])) in exact else NONE
    for j in np.flatnonzero(~name).tolist():
        s, e, k = int(nd.start[j]), int(nd.end[j]), int(nd.kind[j])
        left, right = text[max(0, s - 40) : s], text[e : e + 20]
        if k == EMAIL:
            out[j] = EMAIL
        elif k == ADDRESS:
            out[j] = ADDRESS if ADDRESS_CUE.search(left) else NONE
        elif ID_CUE.search(left) or ID_AFTER.match(right):
            out[j] = ID
        elif PHONE_CUE.search(left) or PHONE_AFTER.match(right):
            out[j] = PHONE
    return out


def spread(text: str, nd: Nodes, y: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Labels with the names of ``known`` (sorted word hashes) at all mentions with a capital; other Han stretches with two-character family names are left open."""
    same = (nd.kind == NAME) & np.isin(nd.word, known)
    for j in np.flatnonzero(same & (y == NONE)).tolist():
        if text[nd.start[j]] != text[nd.start[j]].lower() or "一" <= text[nd.start[j]] <= "鿿":
            y[j] = NAME
    first = np.frombuffer(text.encode("utf-32-le"), np.uint32)[np.minimum(np.stack([nd.start, nd.start + 1]), len(text) - 1)].astype(np.int64)
    y[(nd.kind == NAME) & (y == NONE) & np.isin(first[0] << 21 | first[1], _COMPOUND_KEYS)] = UNKNOWN
    return y


def _fit_two(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int) -> np.ndarray:
    """Weights of features by logistic regression: one label against none."""
    out = np.zeros(1 << FEATURE_BITS, np.float32)
    used, inv = np.unique(x, return_inverse=True)
    inv = inv.reshape(x.shape)
    d, acc = np.zeros(len(used)), np.full(len(used), 1e-8)
    for _ in range(steps if len(x) else 0):
        g = (1 / (1 + np.exp(-d[inv].sum(axis=1))) - y) * weight
        grad = np.bincount(inv.ravel(), np.repeat(g, x.shape[1]), len(used)) + 0.004 * d
        acc += grad * grad
        d -= 0.3 * grad / np.sqrt(acc)
    out[used] = d
    return out


def _fit(x: np.ndarray, t: np.ndarray, weight: np.ndarray, steps: int) -> np.ndarray:
    """Weights of features by multinomial logistic regression."""
    weights = np.zeros((1 << FEATURE_BITS, len(LABELS)), np.float32)
    used, inv = np.unique(x, return_inverse=True)
    inv = inv.reshape(x.shape)
    one = np.eye(len(LABELS))[t]
    wts, acc = np.zeros((len(used), len(LABELS))), np.full((len(used), len(LABELS)), 1e-8)
    for _ in range(steps if len(x) else 0):
        z = wts[inv].sum(axis=1)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = (p - one) * weight[:, None]
        grad = np.stack([np.bincount(inv.ravel(), np.repeat(g[:, c], x.shape[1]), len(used)) for c in range(len(LABELS))], axis=1) + 0.004 * wts
        acc += grad * grad
        wts -= 0.3 * grad / np.sqrt(acc)
    weights[used] = wts
    return weights


def train(texts: list[str], steps: int = 200, seed: int = 3) -> Field:
    """Fit a field on a bounded list of texts labelled by cues, and on sentences made by rule."""
    made = names.sentences(SINGLE, COMPOUND)
    got: list[tuple[str, Nodes, np.ndarray, np.ndarray]] = []
    for i in range(0, len(texts) + 1, 2000):  # in parts: a batch's arrays are many times its text
        some = texts[i : i + 2000] or ["."]
        cps, off = _apart(*traced(*at.to_codepoints(pa.array(some, pa.string())))[:2])
        text = cps.tobytes().decode("utf-32-le")
        nd = nodes(cps, off, text, None)
        got.append((text, nd, off, cued_labels(text, nd, cued_names(text))))
    # words that cues mark as names at least twice, and at one in ten of their mentions
    word, label = (np.concatenate([x[nd_.kind == NAME] for _, nd_, *y_ in got for x in [f(nd_, y_)]]) for f in (lambda n, y: n.word, lambda n, y: y[1]))
    each, inv = np.unique(word, return_inverse=True)
    marked = np.bincount(inv, label == NAME, len(each))
    known = each[(marked >= 2) & (marked >= 0.1 * np.bincount(inv, minlength=len(each)))]
    got = [(t, nd, off, spread(t, nd, y, known)) for t, nd, off, y in got]
    cps, off = _apart(*at.to_codepoints(pa.array([t for t, _ in made], pa.string())))
    nd = nodes(cps, off, text := cps.tobytes().decode("utf-32-le"), None)
    got.append((text, nd, off, cued_labels(text, nd, [(int(a) + s, int(a) + e) for a, (_, ps) in zip(off, made) for s, e in ps])))
    parts, chains, skips, labels, base = [], [], [], [], 0
    for _, nd, off, y in got:
        labels.append(y)
        c, k = edges(nd, off)
        chains.append(c + base)
        skips.append(k + base)
        parts.append((nd.feats, nd.kind))
        base += len(nd.start)
    feats, kind = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    y, chain, skip = np.concatenate(labels), np.concatenate(chains), np.concatenate(skips)
    rng = np.random.default_rng(seed)
    plain = np.flatnonzero((y == NONE) & (kind == NAME))
    # all words of the sentences made by rule, whose labels are exact
    exact = np.arange(len(y)) >= base - len(labels[-1])
    plain = plain[~exact[plain]]
    some = np.flatnonzero(((y != NONE) | (kind != NAME) | exact) & (y != UNKNOWN))
    draw = lambda a, n: rng.choice(a, min(len(a), n), replace=False) if len(a) else a
    k = np.concatenate([some[exact[some]], draw(some[~exact[some]], MENTIONS), draw(plain, 3 * MENTIONS)])
    x, t = feats[k], y[k]
    # a Han stretch without a cue may be a name all the same: it says less than a sentence made by rule
    open_ = np.isin(x[:, 7], _HAN_KINDS) & ~exact[k] & (t == NONE)
    weight = np.where(t == NONE, 1.0, 2.0) * np.where(exact[k], EXACT, np.where(open_, OPEN, 1.0))
    weights = np.zeros((1 << FEATURE_BITS, len(LABELS)), np.float32)
    # names and the other kinds have no feature in common: two models, the first of two labels
    name = kind[k] == NAME
    weights[:, NAME] += _fit_two(x[name], t[name] == NAME, weight[name], steps)
    weights += _fit(x[~name], t[~name], weight[~name], steps)

    def pair(e: np.ndarray, strength: float) -> np.ndarray:
        joint = np.full((len(LABELS), len(LABELS)), 0.5)
        e = e[(y[e] != UNKNOWN).all(axis=1)]
        np.add.at(joint, (y[e[:, 0]], y[e[:, 1]]), 1)
        joint /= joint.sum()
        return strength * np.clip(np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True))), -3, 3)

    skip_pot = np.maximum(pair(skip, 1.0), 0) * np.eye(len(LABELS)) if len(skip) else np.eye(len(LABELS)) * 0.5
    return Field(weights.astype(np.float32), pair(chain, 0.5), skip_pot)


def fitted(df: DataFrame, key: str, text: str, sample: int = SAMPLE) -> Field:
    """Fit a field on at most ``sample`` rows of ``df``, chosen by the hash of their key."""
    # rows of the lowest hashes, by a bound that leaves few over: no task gathers more than about the sample
    share = min(1.0, 2.0 * sample / max(1, df.count()))
    drawn = df.where(F.col(text).isNotNull()).select(F.xxhash64(key).alias("h"), text)
    if share < 1:
        drawn = drawn.where(F.col("h") < F.lit(int(-(2**63) + share * 2**64)))
    rows = drawn.orderBy("h").limit(sample).toArrow()
    return train(rows[text].to_pylist())


def _apart(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a line break after each, so that no pattern runs from one into the next."""
    return np.insert(cps, off[1:], 10), off + np.arange(len(off))


def _mentions(col: pa.Array, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Raw code points and offsets of a column, and row, start, end (raw places) and label of its personal mentions."""
    raw, raw_off = at.to_codepoints(col)
    cps, off, src = traced(raw, raw_off)
    src = np.insert(src if src is not None else np.arange(len(cps)), off[1:], raw_off[1:])
    cps, off = _apart(cps, off)
    text = cps.tobytes().decode("utf-32-le")
    nd = nodes(cps, off, text, field)
    if not len(nd.start):
        z = np.empty(0, np.int64)
        return raw, raw_off, z, z, z, z
    label = infer(nd, off, field)
    hit = label != NONE
    s, e, label = nd.start[hit], nd.end[hit], label[hit]
    row = np.searchsorted(off, s, side="right") - 1
    # up to where the next character comes from, so that marks of the last one go with it
    s, e = src[s], src[e]
    return raw, raw_off, row, s, e, label


def found(df: DataFrame, text: str, field: Field) -> DataFrame:
    """The other columns and pii_type: one row for each type in each text."""
    from pyspark.sql import types as T

    keep = [f for f in df.schema.fields if f.name != text]
    shared = df.sparkSession.sparkContext.broadcast(field)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, [text]):
                _, _, row, _, _, label = _mentions(b.column(text), shared.value)
                if len(row):
                    u = np.unique(row * len(LABELS) + label)
                    pick = pa.array(u // len(LABELS))
                    yield pa.RecordBatch.from_arrays([*(b.column(f.name).take(pick) for f in keep), pa.array(np.array(LABELS, object)[u % len(LABELS)], pa.string())], [*(f.name for f in keep), "pii_type"])

    return df.where(F.col(text).isNotNull()).mapInArrow(run, T.StructType(keep + [T.StructField("pii_type", T.StringType())]))


def redacted(df: DataFrame, text: str, field: Field) -> DataFrame:
    """``df`` with typed placeholders in place of personal mentions in ``text``; all else, nulls included, is unchanged."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, [text]):
                col = b.column(text)
                raw, off, row, s, e, label = _mentions(col, shared.value)
                if len(row):
                    order = np.lexsort((e, s))
                    row, s, e, label = row[order], s[order], e[order], label[order]
                    texts = col.to_pylist()
                    flat = raw.tobytes().decode("utf-32-le")
                    for r in np.unique(row):
                        out, at_ = [], int(off[r])
                        last = NONE
                        for j in np.flatnonzero(row == r) if len(row) < 64 else range(np.searchsorted(row, r), np.searchsorted(row, r, side="right")):
                            gap = flat[at_ : s[j]]
                            if s[j] < at_:
                                continue
                            # a whole name is one placeholder, with initials and hyphens inside it
                            if not (last == label[j] == NAME and re.fullmatch(r"[ \-]|(?: \w\.)? ", gap)):
                                out += [gap, f"[{LABELS[label[j]].upper()}]"]
                            at_, last = int(e[j]), label[j]
                        texts[r] = "".join(out) + flat[at_ : off[r + 1]]
                    col = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([col if n == text else b.column(n) for n in b.schema.names], b.schema.names)

    return df.mapInArrow(run, df.schema)
