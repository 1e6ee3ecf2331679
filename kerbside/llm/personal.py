"""PII: personal data in free text, by fixed patterns and by a semi-Markov conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import SPACES, hashed_share, keyed_text

KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGNAL = re.compile(r"[0-9@]+")
TOKEN = re.compile(f"[^{SPACES}]+")
WORDS_MOST = 6             # words of an entity
CHARS_MOST = 128           # characters of a word that may be part of one
CONTEXT = 3                # words around a signal that belong to its zone
SAMPLE_ZONES = 400         # zones the field is fitted on at most
PASSES = 8


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _at_most_255(digits: str) -> bool:
    short = digits.lstrip("0") or "0"
    return len(short) <= 3 and int(short) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: the local part up to the last match before it, then the domain; linear on long runs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start, found = at, DOMAIN.match(text, at + 1)
        if found:
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, found.end()
                done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping per kind; failing matches are dropped."""
    if not SIGNAL.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(_at_most_255(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return in_order(out)


def in_order(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def zones(text: str) -> list[list[tuple[int, int]]]:
    """Words (start, end) around every digit or @, CONTEXT words to each side; touching zones are one."""
    out: list[list[tuple[int, int]]] = []
    reach = -1
    for signal in SIGNAL.finditer(text):
        if signal.start() < reach:
            continue
        start = signal.start()
        for _ in range(CONTEXT + 1):               # to the start of a word, then back over more words
            while start > 0 and text[start - 1] in SPACES:
                start -= 1
            while start > 0 and text[start - 1] not in SPACES:
                start -= 1
        words, past = [], 0
        for word in TOKEN.finditer(text, max(start, reach, 0)):
            words.append(word.span())
            past = 0 if SIGNAL.search(text, *word.span()) else past + 1
            if word.end() > signal.start() and past >= CONTEXT:
                break
        if not words:
            continue
        reach = words[-1][1]
        if out and words[0][0] <= out[-1][-1][1] + 1:
            out[-1] += words
        else:
            out.append(words)
    return out


NAMES = re.compile(r"\b(pass(word|wd)?|pwd|token|secret|api[_-]?key|key)\b", re.I)
# Questions about a whole span; the answers are the features of a segment.
SPAN_TESTS = (
    lambda s, before: True,
    lambda s, before: "@" in s,
    lambda s, before: bool(re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", s)),
    lambda s, before: s.count(".") == 3,
    lambda s, before: bool(re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", s)),
    lambda s, before: s.startswith("+"),
    lambda s, before: 10 <= len(_digits(s)) <= 13,
    lambda s, before: 14 <= len(_digits(s)) <= 19,
    lambda s, before: 14 <= len(_digits(s)) <= 19 and luhn(_digits(s)),
    lambda s, before: bool(re.fullmatch(r"[\d ()+.-]+", s)),
    lambda s, before: "(" in s and ")" in s,
    lambda s, before: not _digits(s),
    lambda s, before: len(_digits(s)) < 6,
    lambda s, before: bool(re.search(r"[=:]", s)),
    lambda s, before: bool(re.search(r"[0-9a-fA-F]{16,}", s)),
    lambda s, before: bool(re.search(r"[a-f][0-9]|[0-9][a-f]", s)),
    lambda s, before: bool(NAMES.match(s)),
    lambda s, before: bool(NAMES.search(s)),
    lambda s, before: bool(NAMES.search(before)),
    lambda s, before: " " not in s,
    lambda s, before: s.count(" ") == 1,
    lambda s, before: s.count(" ") > 2,
    lambda s, before: bool(re.match(r"[^\W\d]+ ", s)),
    lambda s, before: bool(re.search(r" [^\W\d]+$", s)),
)
EDGE = ".,;:!?"


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without sentence marks at its ends."""
    while end > start and text[end - 1] in EDGE:
        end -= 1
    while start < end and text[start] in EDGE:
        start += 1
    return start, end


class Field:
    """A semi-Markov conditional random field: states are "outside" (one word) and the kinds (up to WORDS_MOST words).

    A segment scores by its kind's weights over the answers to SPAN_TESTS, plus a weight for the change of
    state. Sums and maxima run over all segmentations by dynamic programming over word boundaries.
    """

    def __init__(self):
        self.weights = np.zeros((len(KINDS), len(SPAN_TESTS)))
        self.moves = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    @staticmethod
    def segments(text: str, words: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
        """Features of every candidate segment, by its word range."""
        out = {}
        for i in range(len(words)):
            before = text[words[i - 1][0]: words[i - 1][1]][-CHARS_MOST:] if i else ""
            for j in range(i + 1, min(i + WORDS_MOST, len(words)) + 1):
                if words[j - 1][1] - words[j - 1][0] > CHARS_MOST:
                    break
                a, b = trimmed(text, words[i][0], words[j - 1][1])
                span = text[a:b]
                if SIGNAL.search(span):
                    out[i, j] = np.array([float(test(span, before)) for test in SPAN_TESTS])
        return out

    def _steps(self, n: int, segments: dict) -> list[list[tuple[int, int, float, np.ndarray | None]]]:
        """By end: (start, state, score, features) of the segments that end there; state 0 is outside."""
        steps: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            steps[i + 1].append((i, 0, 0.0, None))
        for (i, j), features in segments.items():
            for k, score in enumerate(self.weights @ features, 1):
                steps[j].append((i, k, float(score), features))
        return steps

    def decode(self, n: int, segments: dict) -> list[tuple[int, int, str]]:
        """The best segmentation's entities: (first word, end word, kind)."""
        steps, states = self._steps(n, segments), len(KINDS) + 1
        best = np.full((n + 1, states), -np.inf)
        best[0, 0] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, n + 1):
            for i, state, score, _ in steps[j]:
                into = best[i] + self.moves[:, state]
                came = int(into.argmax())
                if into[came] + score > best[j, state]:
                    best[j, state] = into[came] + score
                    back[j, state] = (i, came)
        out, j, state = [], n, int(best[n].argmax())
        while j > 0:
            i, came = back[j, state]
            if state:
                out.append((i, j, KINDS[state - 1]))
            j, state = i, came
        return out[::-1]

    def learn(self, n: int, segments: dict, gold: dict[tuple[int, int], int], rate: float, decay: float) -> None:
        """One step up the likelihood of the true segmentation: its features minus their expectation."""
        steps, states = self._steps(n, segments), len(KINDS) + 1
        ahead = np.full((n + 1, states), -np.inf)
        ahead[0, 0] = 0.0
        for j in range(1, n + 1):
            for i, state, score, _ in steps[j]:
                ahead[j, state] = np.logaddexp(ahead[j, state], np.logaddexp.reduce(ahead[i] + self.moves[:, state]) + score)
        behind = np.full((n + 1, states), -np.inf)
        behind[n] = 0.0
        total = np.logaddexp.reduce(ahead[n])
        weights, moves = -decay * self.weights, -decay * self.moves
        for j in range(n, 0, -1):
            for i, state, score, features in steps[j]:
                tail = behind[j, state] + score
                p = np.exp(ahead[i] + self.moves[:, state] + tail - total)
                behind[i] = np.logaddexp(behind[i], self.moves[:, state] + tail)
                moves[:, state] -= p
                if state:
                    weights[state - 1] -= p.sum() * features
        at, came = 0, 0
        while at < n:
            j, state = next(((b, k) for (a, b), k in gold.items() if a == at), (at + 1, 0))
            moves[came, state] += 1
            if state:
                weights[state - 1] += segments[at, j]
            at, came = j, state
        self.weights += rate * weights
        self.moves += rate * moves


ASSIGNED = re.compile(r"\b(password|token|secret|key)\s*[=:]\s*\"?[0-9a-f]{16,}\"?", re.I)


def truth(text: str, words: list[tuple[int, int]], segments: dict) -> dict[tuple[int, int], int]:
    """Segments that carry a pattern's match or an assigned secret, as the field is to learn them."""
    known = [(KINDS.index(k) + 1, a, b) for k, a, b in base_spans(text)]
    known += [(len(KINDS), m.start(), m.end()) for m in ASSIGNED.finditer(text)]
    gold: dict[tuple[int, int], int] = {}
    done = 0
    for kind, a, b in sorted(known, key=lambda s: (s[1], -s[2])):
        inside = [i for i, (s, e) in enumerate(words) if s < b and e > a]
        if inside and inside[0] >= done and (inside[0], inside[-1] + 1) in segments:
            gold[inside[0], inside[-1] + 1] = kind
            done = inside[-1] + 1
    return gold


def fit(samples: list[str]) -> Field:
    """The field that the zones' own pattern matches teach; rare kinds count as often as common ones."""
    field, taught = Field(), []
    for text in samples:
        words = [m.span() for m in TOKEN.finditer(text)]
        segments = field.segments(text, words)
        taught.append((len(words), segments, truth(text, words, segments)))
    for step in range(PASSES):
        for n, segments, gold in taught:
            if segments:
                field.learn(n, segments, gold, 0.3 / (1 + step), 1e-3)
    return field


def spans_of(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(pattern spans, all spans): what the field finds is added where it touches no pattern span of the same place."""
    base = base_spans(text)
    added = []
    for words in zones(text):
        for i, j, kind in field.decode(len(words), field.segments(text, words)):
            a, b = trimmed(text, words[i][0], words[j - 1][1])
            if b > a and all(b <= s or a >= e for _, s, e in base):
                added.append((kind, a, b))
    return base, in_order(base + added)


def find_personal_data(alerts: DataFrame, alert_id: str = "alert_id", description: str = "description",
                       sample_zones: int = SAMPLE_ZONES) -> DataFrame:
    """Personal data in every whole description.

    Returns one row per input row: ``alert_id``, ``base`` and ``spans``, arrays of (kind, first, end) in code
    points with the end exclusive, by start and then kind. ``base`` holds what the fixed patterns match: email,
    ip (parts at most 255), card (14 to 19 digits that pass the Luhn test) and phone (10 to 15 digits), leftmost
    and non-overlapping per kind. ``spans`` adds what the field finds: assigned secrets, and other forms of the
    kinds.

    The field sees the words around every digit and @ (most text has neither) and scores candidate segments of
    up to WORDS_MOST words as wholes; boundaries and kinds are chosen together. It is fitted on at most
    ``sample_zones`` zones of the texts with the smallest hashes, with the patterns' own matches and assignments of
    hexadecimal secrets as teachers. Two passes over the texts find the zones to learn from (one counts, one
    draws), one makes the result; no text is shuffled.

    Defined cases: a null or empty description has no spans; a word longer than CHARS_MOST is no part of an
    entity of the field (the patterns still see it); without zones the field adds nothing; repeated rows and
    rows without an id are treated like any others; an empty table gives an empty result; other columns are not
    read.
    """
    source = keyed_text(alerts, alert_id, description)
    kind = source.schema["key"].dataType.simpleString()

    def excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [text[z[0][0]: z[-1][1]] for text in batch.column(0).to_pylist() for z in zones(text) if len(z) <= 24]
            yield pa.RecordBatch.from_arrays([pa.array([z for z in out if len(z) <= 8 * CHARS_MOST], pa.string())], names=["zone"])

    marked = source.where(F.col("text").rlike("[0-9@]")).select("text")
    drawn = marked.where(hashed_share("text", sample_zones, marked.count()))    # each holds a zone at least
    sample = (drawn.mapInArrow(excerpts, "zone string").distinct().orderBy(F.xxhash64("zone"), "zone").limit(sample_zones).collect())
    field = fit([r["zone"] for r in sample])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            both = [spans_of(text, field) for text in batch.column(1).to_pylist()]
            named = [[[{"kind": k, "first": a, "end": b} for k, a, b in side] for side in pair] for pair in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0] for p in named], span), pa.array([p[1] for p in named], span)],
                                             names=["key", "base", "spans"])

    spans = "array<struct<kind:string,first:long,end:long>>"
    return source.mapInArrow(find, f"key {kind}, base {spans}, spans {spans}").withColumnRenamed("key", alert_id)
