"""Personal data by bootstrapped contextual extraction.

Fixed patterns give seed entities.  The words beside a mention are its lexical patterns; mentions and patterns make a bipartite
graph, which Spark scores in turns: a pattern of a kind is as good as the share of its instances believed to be of that kind, those of
unknown kind counting less, an instance as good as its patterns together.  Patterns of high confidence, backed by several different seeds, discover
identifiers that the fixed patterns miss; their spans are added.

Whatever stands beside the words of such a pattern is an instance: a run of pieces that are not plain words, inner spaces, brackets
and colons included, or several plain words between two patterns.  A single plain word counts against its patterns, but is never added.
Runs of more than 320 characters, the longest that an e-mail address can be, are no instances.

Positions are code points, ends exclusive.  Every finder is linear in the text.

Defined cases: a null text is empty; repeated rows each get the same result; an empty table gives no rows; other columns stay
out of :func:`find` and unchanged in :func:`redact`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaybook.llm.shared import hashed_words, in_small_batches, mix64, settle, span_list

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NEXT_WORD = re.compile(r"[^\W\d_]+")
_PIECE = re.compile(r"\S+")
_PLAIN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_BRACKETED = re.compile(r"\[[^\W\d_]+\]|\([^\W\d_]+\)|\{[^\W\d_]+\}|<[^\W\d_]+>")
_LABEL = re.compile(r"[^\W\d_]+[:=]+(?=[^\s:=])")
_COLONS = re.compile(r"[0-9A-Fa-f.]*(?::[0-9A-Fa-f.]*){2,}(?:%\w+)?[,;.]*")
#: Bytes by class; what is beyond ASCII counts as a letter, and texts where that is wrong go another way.
_ASCII = [chr(i) for i in range(128)]
_NOT_LETTER = np.array([not c.isalpha() for c in _ASCII] + [False] * 128)
_NOT_WORD = np.array([not c.isalnum() for c in _ASCII] + [False] * 128)
_IS_DIGIT = np.array([c.isdigit() for c in _ASCII] + [False] * 128)
_IS_BLANK = np.array([c.isspace() for c in _ASCII] + [False] * 128)
_MARKS = "".join(c for c in _ASCII if c.isprintable() and not c.isalnum() and c not in "()[]{}<>")
#: Longest instance in characters, and most plain words between two patterns.
_LONGEST, _MOST_WORDS = 320, 6


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address starts as far left of its @ as its characters reach, but not inside the address before."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        else:
            # what was looked at once needs no second look: the next address starts after this @
            end = at + 1
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by kind, then start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        # a part of more than three digits after leading zeros exceeds 255
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15]
    return found


def _pieces(text: str, known: list[tuple[str, int, int]]) -> list[tuple[int, int, str, bool]]:
    """Runs without blanks, less the punctuation around them: start, end, sort, whether the next one follows directly.

    Sorts are ``w`` a plain word, ``b`` a word in brackets, ``-`` no letter or digit, ``k`` in a known span, ``n`` all else.
    """
    out: list[tuple[int, int, str, bool]] = []
    taken, at, last = sorted((a, b) for _, a, b in known), 0, -1
    for m in _PIECE.finditer(text):
        whole = m.group()
        cuts = [0, len(whole)]
        if (":" in whole or "=" in whole) and not _COLONS.fullmatch(whole) and (label := _LABEL.match(whole)):
            cuts.insert(1, label.end())
        for low, high in zip(cuts, cuts[1:], strict=False):
            part = whole[low:high]
            core = part if part.isalpha() else part.lstrip("\"'`,;*")
            a = m.start() + low + len(part) - len(core)
            if not core.isalnum():
                core = core.rstrip(".,!?;\"'`*") if core.endswith("::") else core.rstrip(".,!?;:=\"'`*")
                for opening, closing in ("()", "[]", "{}", "<>"):
                    if core.endswith(closing) and opening not in core:
                        core = core.rstrip(closing)
                    if core.startswith(opening) and closing not in core:
                        a, core = a + len(core) - len(core.lstrip(opening)), core.lstrip(opening)
            b = a + len(core)
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if core.isalpha() or _PLAIN.fullmatch(core):
                sort = "w"
            elif _BRACKETED.fullmatch(core):
                sort = "b"
            else:
                # marks of any kind around a plain word leave it one
                bare = core.strip(_MARKS)
                if bare.isalpha() or _PLAIN.fullmatch(bare):
                    a += len(core) - len(core.lstrip(_MARKS))
                    b, sort = a + len(bare), "w"
                else:
                    sort = "n" if any(c.isalnum() for c in core[:_LONGEST]) else "-"
            if at < len(taken) and taken[at][0] < b:
                sort = "k"
            if out and 0 < a - last <= 2 and out[-1][1] == last and "\n" not in text[last:a]:
                out[-1] = (*out[-1][:3], True)
            out.append((a, b, sort, False))
            last = b
    return out


def _runs(pieces: list[tuple[int, int, str, bool]]) -> list[tuple[int, int]]:
    """First and last piece of each run; a word in brackets takes the pieces on both of its sides in."""
    member = [sort == "n" for _, _, sort, _ in pieces]
    for i in range(1, len(pieces) - 1):
        if pieces[i - 1][3] and pieces[i][3]:
            if pieces[i][2] == "b" and pieces[i - 1][2] in "wn" and pieces[i + 1][2] in "wn":
                member[i - 1] = member[i] = member[i + 1] = True
            elif pieces[i][2] == "-" and pieces[i - 1][2] == pieces[i + 1][2] == "n":
                member[i] = True
    out: list[tuple[int, int]] = []
    for i, inside in enumerate(member):
        if inside and out and out[-1][1] == i - 1 and pieces[i - 1][3]:
            out[-1] = (out[-1][0], i)
        elif inside:
            out.append((i, i))
    return out


class Slots:
    """What stands beside the words of given lexical patterns."""

    def __init__(self, patterns: Iterable[str]) -> None:
        self.patterns = frozenset(patterns)
        self.before = frozenset(p[:-2].split(" ")[-1] for p in self.patterns if p.endswith(" _"))
        self.after = frozenset(p[2:] for p in self.patterns if p.startswith("_ "))
        self.words = self.before | self.after

    def fill(self, text: str, known: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int, list[str]]], set[tuple[str, str]]]:
        """Instances as start, end and patterns, and single plain words as pattern and word."""
        if self.words.isdisjoint(_NEXT_WORD.findall(text.lower())):
            return [], set()
        pieces = _pieces(text, known)
        runs = _runs(pieces)
        spans = [(pieces[i][0], pieces[j][1]) for i, j in runs]
        inside = {k for i, j in runs for k in range(i, j + 1)}
        plain: set[tuple[str, str]] = set()
        for i, (a, b, sort, joined) in enumerate(pieces):
            if sort not in "wb" or i in inside:
                continue
            word = text[a:b].lower()
            before = _NEXT_WORD.findall(text[pieces[i - 1][0] : pieces[i - 1][1]].lower()[-64:]) if i else []
            after = _NEXT_WORD.search(text[pieces[i + 1][0] : pieces[i + 1][1]][:64].lower()) if i + 1 < len(pieces) else None
            if not (before and before[-1] in self.before or after and after.group() in self.after):
                continue
            plain |= {(p, word) for p in contexts(text, a, b) if p in self.patterns}
            if before and before[-1] in self.before and joined:
                j = i
                while j - i < _MOST_WORDS and j + 1 < len(pieces) and pieces[j][3] and pieces[j + 1][2] == "w" and j + 1 not in inside:
                    j += 1
                    follows = _NEXT_WORD.search(text, pieces[j][1], pieces[j][1] + 48)
                    if j - i >= 2 and follows and follows.group().lower() in self.after:
                        spans.append((a, pieces[j][1]))
                        break
        found = []
        for a, b in spans:
            if b - a <= _LONGEST and (own := [p for p in contexts(text, a, b) if p in self.patterns]):
                found.append((a, b, own))
        return found, plain


def contexts(text: str, start: int, end: int, reach: int = 48) -> list[str]:
    """Lexical patterns of a mention: the word before it, the two before it, the word after it, lower-cased."""
    before = _NEXT_WORD.findall(text[max(0, start - reach) : start].lower())
    after = _NEXT_WORD.search(text[end : end + reach].lower())
    found = []
    if before:
        found.append(f"{before[-1]} _")
    if len(before) > 1:
        found.append(f"{before[-2]} {before[-1]} _")
    if after:
        found.append(f"_ {after.group()}")
    return found


def _value(text: str, a: int, b: int) -> str:
    """The text of a span; one that is too long to be kept is told from others by its digest."""
    return text[a:b] if b - a <= _LONGEST else f"{text[a : a + _LONGEST]}{hashlib.sha256(text[a:b].encode('utf-8', 'surrogatepass')).hexdigest()}"


_FOUND = "doc_id long, key long, n_email long, n_ip long, n_card long, n_phone long, spans string, mentions array<struct<kind:string,value:string,start:int,end:int,patterns:array<string>>>"
_MENTIONS = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("patterns", pa.list_(pa.string()))]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            counts: list[list[int]] = [[] for _ in KINDS]
            spans, mentions = [], []
            for cell in batch.column(2):
                text = cell.as_py() or ""
                known = base_spans(text)
                for column, kind in zip(counts, KINDS, strict=True):
                    column.append(sum(k == kind for k, _, _ in known) if known else 0)
                spans.append(span_list(known))
                mentions.append([{"kind": k, "value": _value(text, a, b), "start": a, "end": b, "patterns": contexts(text, a, b)} for k, a, b in known])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(spans, pa.string()), pa.array(mentions, _MENTIONS)],
                names=["doc_id", "key", *(f"n_{k}" for k in KINDS), "spans", "mentions"],
            )


#: Of so many different words one is counted.
_ONE_IN = 4
#: Numbers of 64 bits that hold a bit for each of these words, and what is counted.
_BITS = 16
_COUNTED = ["pattern", "plain", "other", *(f"b{k}" for k in range(_BITS))]


class PatternHashes:
    """Where the words of lexical patterns stand in lower-cased texts, found for all words of a batch at once."""

    def __init__(self, patterns: list[str]) -> None:
        self.patterns = patterns
        before = [p[:-2].split(" ") for p in patterns if p.endswith(" _")]
        at = [k for k, p in enumerate(patterns) if p.endswith(" _")]
        one = [(k, w[0]) for k, w in zip(at, before, strict=True) if len(w) == 1]
        two = [(k, w) for k, w in zip(at, before, strict=True) if len(w) == 2]
        after = [(k, p[2:]) for k, p in enumerate(patterns) if p.startswith("_ ")]
        self.one = self._sorted([k for k, _ in one], self._hashes([w for _, w in one]))
        self.two = self._sorted([k for k, _ in two], self.pairs(self._hashes([w[0] for _, w in two]), self._hashes([w[1] for _, w in two])))
        self.after = self._sorted([k for k, _ in after], self._hashes([w for _, w in after]))

    @staticmethod
    def _hashes(words: list[str]) -> np.ndarray:
        return hashed_words(" ".join(words).encode(), _NOT_LETTER)[0] if words else np.empty(0, np.uint64)

    @staticmethod
    def pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(first * np.uint64(3) + second)

    @staticmethod
    def _sorted(place: list[int], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(hashes)
        return hashes[order], np.array(place, np.int64)[order]

    @staticmethod
    def _found(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions among ``hashes`` and the pattern at each."""
        known, place = table
        if not len(known) or not len(hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        i = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        at = np.flatnonzero(known[i] == hashes)
        return at, place[i[at]]

    def __call__(self, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Words that end or begin a pattern, the pattern, and on which side of the word its slot is."""
        one, two, after = self._found(self.one, hashes), self._found(self.two, self.pairs(hashes[:-1], hashes[1:])), self._found(self.after, hashes)
        return [(*one, 1), (two[0] + 1, two[1], 1), (*after, -1)]


def _counter(patterns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each pattern how many different plain words stand beside it in a task, how often anything else does, and a bit for each of the words.

    Of words only a quarter, told by their hash, is looked at.
    """
    known = PatternHashes(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = np.zeros(len(patterns), np.int64)
        # pattern and filler in one number
        shift = np.uint64(64 - max(len(patterns) - 1, 1).bit_length())
        seen = np.empty(0, np.uint64)
        held: list[np.ndarray] = []
        for batch in batches:
            # a digit between texts is no plain word
            raw = "\n0\n".join(t.lower() for t in batch.column(2).to_pylist() if t).encode("utf-8", "surrogatepass") + b"\n0\n"
            hashes, edges = hashed_words(raw, _NOT_WORD)
            first, last = edges[::2], edges[1::2]
            if not len(hashes):
                continue
            octets = np.frombuffer(raw, np.uint8)
            digits, blanks = (np.concatenate([[0], np.cumsum(kind[octets])]) for kind in (_IS_DIGIT, _IS_BLANK))
            # a plain word has no digit, and blanks part it from the words on both sides, whatever marks there are
            parted = blanks[np.append(first, len(raw))] > blanks[np.concatenate([[0], last])]
            parted[0] = True
            plain = (digits[last] == digits[first]) & parted[:-1] & parted[1:]
            for at, pattern, side in known(hashes):
                slot = at + side
                inside = (slot >= 0) & (slot < len(hashes))
                slot = np.clip(slot, 0, len(hashes) - 1)
                word = plain[slot] & inside
                other += np.bincount(pattern[~word], minlength=len(patterns))
                keep = word & ((hashes[slot] & np.uint64(_ONE_IN - 1)) == 0)
                if keep.any():
                    held.append(np.unique((pattern[keep].astype(np.uint64) << shift) | (hashes[slot[keep]] >> (np.uint64(64) - shift))))
            if sum(map(len, held)) > max(500_000, len(seen)):
                seen, held = np.unique(np.concatenate([seen, *held])), []
        seen = np.unique(np.concatenate([seen, *held]))
        pattern, bit = (seen >> shift).astype(np.int64), seen & np.uint64(64 * _BITS - 1)
        bits = np.zeros((len(patterns), _BITS), np.uint64)
        np.bitwise_or.at(bits, (pattern, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        counts = np.bincount(pattern, minlength=len(patterns))
        some = np.flatnonzero(counts + other)
        # numbers only: the words of the few patterns that stay in are sent later, with their slots
        columns = [pa.array(counts[some]), pa.array(other[some]), *(pa.array(bits[some, k].view(np.int64)) for k in range(_BITS))]
        yield pa.RecordBatch.from_arrays([pa.array([patterns[k] for k in some], pa.string()), *columns], names=_COUNTED)

    return run


_FILLED = "doc_id long, key long, mentions array<struct<kind:string,value:string,start:int,end:int,patterns:array<string>>>, plain array<struct<pattern:string,value:string>>"
_WORDS = pa.list_(pa.struct([("pattern", pa.string()), ("value", pa.string())]))


#: What is looked at on both sides of a pattern's word: the longest instance, and more than its contexts reach.
_AROUND = _LONGEST + 192


def windows(places: Iterable[int], length: int) -> list[tuple[int, int]]:
    """Stretches of a text around ascending places."""
    out: list[tuple[int, int]] = []
    for x in places:
        low, high = max(0, x - _AROUND), min(length, x + _AROUND)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def _filler(patterns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    slots, known = Slots(patterns), PatternHashes(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, mentions, words = [], [], [], set()
            for doc_id, key, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), _hit_places(batch.column(2).to_pylist(), known), strict=True):
                if not places:
                    continue
                spans = base_spans(text)
                found = []
                for low, high in windows(places, len(text)):
                    inner, plain = slots.fill(text[low:high], [(k, a - low, b - low) for k, a, b in spans if a < high and b > low])
                    words |= plain
                    found += [(a + low, b + low, p) for a, b, p in inner]
                if found:
                    ids.append(doc_id)
                    keys.append(key)
                    mentions.append([{"kind": "", "value": text[a:b], "start": a, "end": b, "patterns": p} for a, b, p in found])
            # the plain words of a batch are in a row of their own
            rows = [[], *([] for _ in ids)]
            rows[0] = [{"pattern": p, "value": v} for p, v in words]
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *ids], pa.int64()), pa.array([None, *keys], pa.int64()), pa.array([[], *mentions], _MENTIONS), pa.array(rows, _WORDS)],
                names=["doc_id", "key", "mentions", "plain"],
            )

    return run


def _odd(lower: str) -> bool:
    """Whether a text has characters beyond ASCII that :data:`_NEXT_WORD` takes for no letters."""
    return not lower.isascii() and any(c > "\x7f" and not (c.isalnum() and not c.isdecimal()) for c in set(lower))


def _hit_places(texts: list[str | None], known: PatternHashes) -> list[list[int]]:
    """For each text the places, in code points, of words that a pattern has beside its slot."""
    out: list[list[int]] = [[] for _ in texts]
    usual: list[int] = []
    parts: list[bytes] = []
    for k, text in enumerate(texts):
        if not text:
            continue
        lower = text.lower()
        if len(lower) == len(text) and not _odd(lower):
            usual.append(k)
            parts.append(lower.encode("utf-8", "surrogatepass"))
            continue
        # letters are told from the rest by the expression, and places by what it finds
        found = list(_NEXT_WORD.finditer(lower))
        hashes = hashed_words(" ".join(m.group() for m in found).encode("utf-8", "surrogatepass"), _IS_BLANK)[0]
        hit = sorted({int(x) for places, _, _ in known(hashes) for x in places}) if len(hashes) else []
        # where lower-casing lengthens a text, all of it is looked at
        out[k] = list(range(0, len(text), _AROUND)) if hit and len(lower) != len(text) else [found[x].start() for x in hit]
    # the others are searched together; a pair of words from two texts only makes a place to look at
    raw = b"\n".join(parts)
    hashes, edges = hashed_words(raw, _NOT_LETTER)
    if not len(hashes):
        return out
    at = edges[::2][np.unique(np.concatenate([places for places, _, _ in known(hashes)]))]
    starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
    of = np.searchsorted(starts, at, "right") - 1
    for k in np.unique(of).tolist():
        places = at[of == k] - starts[k]
        part = np.frombuffer(parts[k], np.uint8)
        if len(parts[k]) != len(texts[usual[k]]):
            # every byte but the continuing ones begins a code point
            places = np.cumsum((part & 0xC0) != 0x80)[places] - 1
        out[usual[k]] = places.tolist()
    return out


@dataclass(frozen=True)
class BootstrapConfig:
    #: Turns at most; scoring ends with the first turn that changes no instance.
    rounds: int = 6
    #: Different seed values that a pattern needs, and the least confidence of patterns and of added instances.
    least_seeds: int = 3
    #: Confident patterns that an instance needs to be believed.
    least_patterns: int = 2
    pattern_confidence: float = 0.8
    #: What an instance of unknown kind counts against a pattern; a plain word, or one of another kind, counts 1.
    unknown_weight: float = 0.25
    instance_confidence: float = 0.95
    #: Patterns that may be sent to every task; with more of them the operator stops with an error and drops none.
    most_patterns: int = 4_000_000


def score_graph(edges: DataFrame, config: BootstrapConfig = BootstrapConfig()) -> tuple[DataFrame, DataFrame]:
    """Patterns ``pattern, kind, confidence`` and discovered ``value, kind, score`` from distinct ``pattern, value, kind`` edges.

    An edge of a seed has its kind, one of an unknown value the empty string, one of a value that cannot be discovered none.
    """
    seeds = edges.where("kind <> ''").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    totals = edges.groupBy("pattern").agg(F.countDistinct("value").alias("total"), F.countDistinct(F.when(F.col("kind") == "", F.col("value"))).alias("unknown"))
    unknown = edges.where("kind = ''").select("pattern", "value")
    believed = seeds.withColumn("seed", F.lit(1))
    patterns = backed = last = None
    links = edges.where("kind is not null").select("pattern", "value").distinct()
    for _ in range(config.rounds):
        mass = links.join(believed, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.sum("seed").alias("seeds"), F.sum(1 - F.col("seed")).alias("found"))
        # an instance that nothing is known of yet says little against its pattern
        against = F.col("total") - (1 - config.unknown_weight) * (F.col("unknown") - F.col("found"))
        confident = mass.where(F.col("seeds") >= config.least_seeds).join(totals, "pattern").withColumn("confidence", F.col("mass") / against)
        patterns = settle(confident.where(F.col("confidence") >= config.pattern_confidence).select("pattern", "kind", "confidence"))
        doubt = F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999))))
        found = settle(unknown.join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score"), F.count("*").alias("n")))
        # what one pattern alone suggests would feed that pattern's own confidence
        before, backed = backed, found.where(F.col("n") >= config.least_patterns).drop("n")
        state = lambda df: df.agg(F.count("*"), F.sum(F.round("score", 6)), F.sum(F.xxhash64("value", "kind") % 1_000_003)).first()
        now = state(backed)
        if before is not None and now == last or not now[0]:
            break
        last = now
        believed = seeds.withColumn("seed", F.lit(1)).unionByName(backed.withColumn("seed", F.lit(0)))
    best = backed.where(F.col("score") >= config.instance_confidence).groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b"))
    return patterns, best.select("value", "b.kind", "b.score")


def find(docs: DataFrame, config: BootstrapConfig = BootstrapConfig()) -> DataFrame:
    """``doc_id, key, n_*, base_sha256, spans, n_added``; ``key`` is ``xxhash64(text)``."""
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    base = settle(rows.mapInArrow(_scan, _FOUND))
    of = lambda df: df.where("size(mentions) > 0").select("doc_id", "key", F.explode("mentions").alias("m"))
    edge = lambda df: df.select(F.explode("m.patterns").alias("pattern"), F.col("m.value").alias("value"), F.col("m.kind").alias("kind"))
    seeds = settle(edge(of(base)).distinct())
    # a pattern with fewer seeds can never be confident, so what else stands beside it does not matter
    backed = {r["pattern"]: r["n"] for r in seeds.groupBy("pattern", "kind").count().where(F.col("count") >= config.least_seeds).groupBy("pattern").agg(F.sum("count").alias("n")).collect()}
    if len(backed) > config.most_patterns:
        raise ValueError(f"{len(backed)} patterns have {config.least_seeds} seeds or more; raise least_seeds, as {config.most_patterns} are sent to every task at most")
    # nor can one with too many plain words, even if all else that stands beside it, counted twice over, were of its kind
    if backed:
        counted = rows.mapInArrow(_counter(list(backed)), "pattern string, " + ", ".join(f"{c} long" for c in _COUNTED[1:]))
        sums = counted.groupBy("pattern").agg(F.max("plain").alias("plain"), F.sum("other").alias("other"), *[F.bit_or(c).alias(c) for c in _COUNTED[3:]])
        room = 1 / config.pattern_confidence - 1
        for r in sums.collect():
            # words that were looked at: those of one task, or of all by the bits that are left; two and a half times as many as there
            # may be are no accident
            left = 64 * _BITS - sum((r[c] & (1 << 64) - 1).bit_count() for c in _COUNTED[3:])
            words = max(r["plain"], 64 * _BITS * math.log(64 * _BITS / max(left, 1)))
            if words >= 40 and words * _ONE_IN > 2.5 * room * (backed[r["pattern"]] + 2 * r["other"]):
                del backed[r["pattern"]]
    patterns = list(backed)
    # without a pattern that stays in, no slot needs a look
    filled = settle(rows.mapInArrow(_filler(patterns), _FILLED)) if patterns else docs.sparkSession.createDataFrame([], _FILLED)
    words = filled.select(F.explode("plain").alias("w")).select("w.pattern", "w.value", F.lit(None).cast("string").alias("kind"))
    edges = settle(seeds.unionByName(edge(of(filled))).unionByName(words).distinct())
    _, added = score_graph(edges, config)
    wanted = of(filled).select("doc_id", "key", F.col("m.value").alias("value"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))
    each = wanted.join(added, "value").select("doc_id", "key", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("o"), "start", "end", "kind").distinct()
    more = each.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.array_sort(F.collect_list(F.struct("o", "start", "end", "kind"))).alias("more"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))
    out = base.drop("mentions").join(more, same, "left")
    # all spans in the order of the contract: by kind, then start
    parsed = F.transform(
        F.filter(F.split("spans", ","), lambda s: s != ""),
        lambda s: F.struct(
            F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]).alias("o"), F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end"), F.split(s, ":")[0].alias("kind")
        ),
    )
    every = F.array_join(F.transform(F.array_sort(F.concat(parsed, "more")), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(
        "doc_id",
        "key",
        *[f"n_{k}" for k in KINDS],
        F.sha2("spans", 256).alias("base_sha256"),
        F.when(F.col("more").isNull(), F.col("spans")).otherwise(every).alias("spans"),
        F.when(F.col("more").isNull(), 0).otherwise(F.size("more")).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, config: BootstrapConfig = BootstrapConfig(), broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; ``n_chars``, if there, follows the text.

    Where spans of two kinds overlap, the one that starts first is replaced, the longer one of equal starts.
    """
    found = find(docs, config).where("spans <> ''").select(F.col("doc_id").alias("__qb_id"), F.col("key").alias("__qb_key"), F.col("spans").alias("__qb_spans"))
    found = settle(found.distinct())
    if (found.agg(F.sum(F.length("__qb_spans") + 32)).first()[0] or 0) <= broadcast_bytes:
        found = F.broadcast(found)
    keyed = docs.withColumn("__qb_own", F.xxhash64("text"))
    joined = keyed.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__qb_id")) & (F.col("__qb_own") == F.col("__qb_key")), "left")
    return joined.select(*docs.columns, "__qb_spans").mapInArrow(_redactor(docs.schema), docs.schema)


def redacted(text: str, spans: Iterable[tuple[str, int, int]]) -> str:
    """The text with spans replaced, in one go over it."""
    out, at = [], 0
    for a, b, kind in sorted((a, -b, kind) for kind, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = -b
    return "".join([*out, text[at:]])


def _redactor(schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            hit = [i for i, x in enumerate(batch.column(len(names)).to_pylist()) if x]
            if hit:
                texts = columns[names.index("text")].to_pylist()
                sizes = columns[names.index("n_chars")].to_pylist() if "n_chars" in names else None
                for i in hit:
                    spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in batch.column(len(names))[i].as_py().split(","))]
                    texts[i] = redacted(texts[i], spans)
                    if sizes:
                        sizes[i] = len(texts[i])
                columns[names.index("text")] = pa.array(texts, columns[names.index("text")].type)
                if sizes:
                    kind = columns[names.index("n_chars")].type
                    columns[names.index("n_chars")] = pa.array([str(x) if x is not None and pa.types.is_string(kind) else x for x in sizes], kind)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run
