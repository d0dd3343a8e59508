"""Personal data by a linear-chain conditional random field over word shapes, and exact forms.

The field is trained on the small table below by maximum likelihood: forward and backward sums in
numpy, all sentences at once. Lines of many documents are decoded together by Viterbi, one step a
token for all of them. Exact forms (mail and network addresses, card and phone numbers) are checked on
the whole text; what the field finds besides is added under kinds of its own, a card number only if it
passes the Luhn test as well.

Cases: null text is empty; matches that fail their test are dropped and not retried; long lines and
digit runs take linear time; an empty table gives an empty result; other columns are ignored; rows with
equal ids are read each.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import SLICE, Span, _arrow_schema, documents, id_and_text, join_spans
from lattica.session import ship_package

LABELS = ("other", "email", "ip", "card", "phone")
BASE = LABELS[1:]
#: The field's own kinds, listed after the base ones.
KINDS = (*BASE, *(f"crf_{k}" for k in BASE))

#: The labelled table. Braces hold a label and the tokens that have it.
TABLE = """
please write to {email anna.k@mail.example.org} before noon
Contact: {email bob_77@example.com}, or call {phone +1 (212) 555-0147} today.
his address is {email <j.doe@example.co.uk>} and mine is {email me@site.example.net}
mail {email sales+eu@shop.example.com}; we answer soon
send it to {email x.y@example.info} and {email z@example.biz}
host {ip 10.0.0.17} answered after 3 tries
from {ip 192.168.1.254}, port 8080, to {ip 172.16.5.4}.
the server at {ip 203.0.113.9} was down for 15 minutes
login from {ip 198.51.100.23} at 12:30 on 2024-05-01
card {card 4111111111111111} expires 09/27
pay with {card 5500-0000-0000-0004} or {card 4012 8888 8888 1881} please.
number {card 378282246310005} was refused, code 51
her card {card 6011 1111 1111 1117}, twice
Tel. {phone +44 20 7946 0958} or {phone +49 30 901820}
ring {phone (212) 555-0199} after 5 pm
phone {phone +1 (415) 555-2671}, fax {phone +1 415-555-2672}.
my number: {phone 555-867-5309}, ask for Ann
call {phone +33 1 70 18 99 00} in the morning
the office is at {phone (303) 555-0142}, ask for Maria
we saw {phone (617) 555-0175} written on the door
{phone (808) 555-0113} is the number of the desk
dial {phone 212-555-0186} or {phone 646-555-0121}. Thanks
please answer {phone 503-555-0164} again
{phone 702-555-0159}, that is the line for guests
reach us: {phone 415.555.0133} or {phone 415.555.0148}.
old line {phone 020 7946 0321} and new line {phone 030 901 8214}
her older card {card 4917610000000} still works, as does card {card 4222222000003}
paid with {card 4000.0566.5566.5556} at noon, then by card {card 5105.1051.0510.5100}.
account 20240501 was opened on 2024-05-01, closed on 2025-11-30
pages 101-118 and 203-219 of part 4-11, isbn 978-0-306-40615-7
the part 555-0142 of item (212) costs 14.50
chapter 12.3.1 lists 45 items and 1,250 pages
in 1998 the price rose from 3.50 to 4.75 dollars
version 2.10.4 was built on 2023-11-05 at 10:15
The quick brown fox jumps over the lazy dog.
und der die das mit von, nicht auf zu. Ein Haus
la maison est grande et les enfants jouent, n'est-ce pas?
it was read by 1,000 people in 20 towns; see p. 14-19.
@home and @work are tags, C++ and a+b are not numbers
see items (a), (b) and [3] - or 5*7=35, 50% of 10
HELLO!! WORLD!! THIS!! IS!! LOUD!!
data$$$ from*** page### is%%% noise&&& here***
order no. 20240117 and invoice 99812 are closed
"""

_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b for b in range(256))
_WORD = re.compile(rb"[^\x09-\x0d\x20]+")
_RUNS = re.compile(rb"(a+|A+|0+)")
BUCKETS = 1 << 11


def shape_features(shape: bytes) -> list[int]:
    """Buckets of a word's shape (letters a and A, digits 0): collapsed form, ends, marks and amounts."""
    short = _RUNS.sub(lambda m: m[0][:1], shape)
    digits = shape.count(b"0")
    names = [
        b"s" + short[:24], b"p" + short[:2], b"e" + short[-2:], b"d%d" % min(digits, 20), b"l%d" % min(len(shape) // 3, 8),
        b"@%d" % (b"@" in shape), b".%d" % min(shape.count(b"."), 4), b"+%d" % shape.startswith(b"+"), b"m%d" % (digits * 2 > len(shape)),
    ]
    return [zlib.crc32(n) % BUCKETS for n in names]


def labelled_rows() -> list[tuple[list[bytes], list[int]]]:
    rows = []
    for line in TABLE.strip().splitlines():
        words, labels = [], []
        for part in re.findall(r"\{[^}]*\}\S*|\S+", line):
            label, inner = 0, part
            if part[0] == "{":
                name, _, inner = part[1:].partition(" ")
                label, inner = LABELS.index(name), inner.replace("}", "")
            for w in inner.split():
                words.append(w.encode().translate(_SHAPE))
                labels.append(label)
        rows.append((words, labels))
    return rows


class Field:
    """Weights of a word's own shape and of its neighbours' shapes for each label, and of label pairs."""

    def __init__(self, own: np.ndarray, before: np.ndarray, after: np.ndarray, pairs: np.ndarray):
        self.own, self.before, self.after, self.pairs = own, before, after, pairs

    @staticmethod
    def trained(rows: list[tuple[list[bytes], list[int]]], rounds: int = 150, rate: float = 0.3, decay: float = 1e-3) -> Field:
        k, longest = len(LABELS), max(len(w) for w, _ in rows)
        n = len(rows)
        width = len(shape_features(b"a"))
        feats = np.full((n, longest + 2, width), BUCKETS)  # the last bucket stands for no word
        gold, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, (words, labels) in enumerate(rows):
            for j, w in enumerate(words):
                feats[i, j + 1] = shape_features(w)
            gold[i, : len(labels)], real[i, : len(labels)] = labels, True
        mid, prev, following = feats[:, 1:-1], feats[:, :-2], feats[:, 2:]
        weights = [np.zeros((BUCKETS + 1, k)) for _ in range(3)] + [np.zeros((k, k))]
        memory = [np.full_like(w, 1e-8) for w in weights]
        truth = np.eye(k)[gold] * real[..., None]
        both = real[:, 1:] & real[:, :-1]
        pair_truth = np.einsum("ntk,ntl->kl", truth[:, :-1] * both[..., None], truth[:, 1:])
        for _ in range(rounds):
            emit = weights[0][mid].sum(2) + weights[1][prev].sum(2) + weights[2][following].sum(2)
            forward, backward = np.zeros((n, longest, k)), np.zeros((n, longest, k))
            forward[:, 0] = emit[:, 0]
            for t in range(1, longest):
                step = _log_sum(forward[:, t - 1, :, None] + weights[3][None], 1) + emit[:, t]
                forward[:, t] = np.where(real[:, t, None], step, forward[:, t - 1])
            for t in range(longest - 2, -1, -1):
                step = _log_sum(weights[3][None] + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
                backward[:, t] = np.where(real[:, t + 1, None], step, 0)
            whole = _log_sum(forward[:, -1], 1)
            node = np.exp(forward + backward - whole[:, None, None]) * real[..., None]
            pair = np.zeros((k, k))
            for t in range(1, longest):
                joint = forward[:, t - 1, :, None] + weights[3][None] + (emit[:, t] + backward[:, t])[:, None, :] - whole[:, None, None]
                pair += (np.exp(np.minimum(joint, 0)) * both[:, t - 1, None, None]).sum(0)
            slope = [np.zeros_like(w) for w in weights[:3]] + [pair_truth - pair]
            for g, at in zip(slope, (mid, prev, following), strict=False):
                for f in range(width):
                    np.add.at(g, at[..., f], truth - node)
            for w, g, m in zip(weights, slope, memory, strict=True):
                g -= decay * n * w
                m += g * g
                w += rate * g / np.sqrt(m)
        return Field(*weights)

    def scores(self, shape: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a word of this shape adds to its own place, to the next one and to the one before."""
        at = shape_features(shape)
        return self.own[at].sum(0), self.before[at].sum(0), self.after[at].sum(0)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return Field.trained(labelled_rows())


class Decoder:
    """Viterbi over many lines at once; shapes are numbered as they appear, with their scores."""

    #: Cells (lines times longest line) decoded together, and shapes remembered.
    CELLS, SHAPES = 1 << 16, 200_000

    def __init__(self, field: Field):
        self.field = field
        width = field.own.shape[1]
        none = len(shape_features(b"a")) * np.array([field.before[BUCKETS], field.after[BUCKETS]])
        self.edge = none.astype(np.float32)
        self._clear(width)

    def _clear(self, width: int) -> None:
        self.ids: dict[bytes, int] = {b"": 0}
        self.rows = [np.zeros((3, width), np.float32)]
        self.table = np.stack(self.rows)

    def number(self, words: list[bytes]) -> list[int]:
        ids = self.ids
        if new := [w for w in set(words) if w not in ids]:
            if len(ids) + len(new) > self.SHAPES:
                self._clear(self.field.own.shape[1])
                ids, new = self.ids, list(set(words))
            for w in new:
                ids[w] = len(self.rows)
                self.rows.append(np.array(self.field.scores(w), np.float32))
            self.table = np.stack(self.rows)
        return list(map(ids.__getitem__, words))

    def decode(self, lines: list[list[int]]) -> list[np.ndarray]:
        """The best labels of each line of numbered words."""
        out: list[np.ndarray] = [np.empty(0, np.uint8)] * len(lines)
        order = sorted((i for i, x in enumerate(lines) if x), key=lambda i: len(lines[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(lines[order[end]]) <= self.CELLS:
                end += 1
            group = order[at:end]
            for i, labels in zip(group, self._together([lines[i] for i in group]), strict=True):
                out[i] = labels
            at = end
        return out

    def _together(self, lines: list[list[int]]) -> list[np.ndarray]:
        n = np.array([len(x) for x in lines])
        longest, k = int(n[-1]), self.table.shape[2]
        ids = np.zeros((longest, len(lines)), np.int64)
        ids.T[np.arange(longest)[None, :] < n[:, None]] = np.concatenate([np.asarray(x) for x in lines])
        pairs = self.field.pairs.astype(np.float32)
        back = np.zeros((longest, k, len(lines)), np.uint8)
        score = None
        for t in range(longest):
            emit = self.table[ids[t], 0].T + (self.table[ids[t - 1], 1].T if t else self.edge[0][:, None])
            emit += np.where(n > t + 1, self.table[ids[t + 1], 2].T if t + 1 < longest else 0, self.edge[1][:, None])
            if score is None:
                score = emit
                continue
            options = score[:, None, :] + pairs[:, :, None]
            back[t] = options.argmax(0)
            score = np.where(n > t, options.max(0) + emit, score)
        label = score.argmax(0)
        out = np.zeros((longest, len(lines)), np.uint8)
        lanes = np.arange(len(lines))
        for t in range(longest - 1, -1, -1):
            inside = n > t
            out[t, inside] = label[inside]
            if t:
                label = np.where(inside, back[t, label, lanes], label)
        return [out[:m, i] for i, m in enumerate(n)]


# -- exact forms ------------------------------------------------------------------------------

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def exact_forms(text: str) -> list[Span]:
    """Leftmost greedy matches of each kind that pass its test."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end(), "email"))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text) if text.count(".") > 2 else ():
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return out


def _plausible(kind: str, word: bytes) -> bool:
    digits = bytes(b for b in word if 48 <= b <= 57)
    if kind == "email":
        return b"@" in word[1:-1]
    if kind == "ip":
        return word.count(b".") == 3 and len(digits) >= 4
    return 13 <= len(digits) <= 19 and luhn(digits.decode()) if kind == "card" else 7 <= len(digits) <= 15


class _Places:
    """Code points of one text's bytes, and which of them its exact spans leave free."""

    def __init__(self, data: bytes, spans: list[Span]):
        raw = np.frombuffer(data, np.uint8)
        self.points = None if data.isascii() else np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        spans = sorted(spans)
        self.starts = [s for s, _, _ in spans]
        self.ends = list(accumulate((e for _, e, _ in spans), max))

    def point(self, byte: int) -> int:
        return byte if self.points is None else int(self.points[byte])

    def free(self, start: int, stop: int) -> bool:
        before = bisect_left(self.starts, stop)
        return not before or self.ends[before - 1] <= start


def find(texts: list[str], decoder: Decoder) -> list[list[Span]]:
    """Spans of each text in code points: exact ones, and the field's that overlap none of them."""
    lines, owner = [], []
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        at = 0
        for shaped in data.translate(_SHAPE).split(b"\n"):
            lines.append((data, at, shaped))
            owner.append(i)
            at += len(shaped) + 1
    words = [shaped.split() for _, _, shaped in lines]
    flat = decoder.number([w for ws in words for w in ws])
    numbered, at = [], 0
    for ws in words:
        numbered.append(flat[at : at + len(ws)])
        at += len(ws)
    out = [exact_forms(t) for t in texts]
    places_of: dict[int, _Places] = {}
    for i, (data, begin, shaped), labels in zip(owner, lines, decoder.decode(numbered), strict=True):
        if not labels.any():
            continue
        places = [m.span() for m in _WORD.finditer(shaped)]
        found, t = [], 0
        while t < len(labels):
            end = t + 1
            while end < len(labels) and labels[end] == labels[t]:
                end += 1
            if labels[t]:
                found.append((begin + places[t][0], begin + places[end - 1][1], LABELS[labels[t]]))
            t = end
        for s, e, kind in found:
            while e > s and data[e - 1] in b".,;:!?)>]}\"'":
                e -= 1
            while s < e and data[s] in b"<[{\"'":
                s += 1
            if not _plausible(kind, data[s:e]):
                continue
            if i not in places_of:
                places_of[i] = _Places(data, out[i])
            start, stop = places_of[i].point(s), places_of[i].point(e)
            if places_of[i].free(start, stop):
                out[i].append((start, stop, f"crf_{kind}"))
    return out


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_<kind> for the base kinds, base_sha256 and spans for each row."""
    field = field or default_field()
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    arrow = _arrow_schema(docs.sparkSession, schema)
    ship_package(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = []
                for spans in find(part.column(1).to_pylist(), decoder):
                    own = [s for s in spans if s[2] in BASE]
                    out.append((*[sum(s[2] == k for s in own) for k in BASE], hashlib.sha256(join_spans(own, KINDS).encode()).hexdigest(), join_spans(spans, KINDS)))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(arrow)[1:], strict=True)]], schema=arrow)

    return id_and_text(docs).mapInArrow(rows, schema)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))
