"""Toxicity of texts that hide their words: a noisy channel undone, then a score of what it hid.

Method.  A writer's words are thought to have passed a channel that swaps letters for look-alikes, spaces letters out and
repeats them.  A suspect stretch of a text becomes a lattice of what each character may have stood for; Viterbi decoding
finds the path of the greatest probability under the channel and a character language model (n-grams of 1 to ``ORDER`` characters,
each order interpolated with the next shorter one).  The restored text is scored: each word by the best of its features (the
word, its first three to five letters), whose weight is the log odds of the lower confidence bound of their toxic share; a logistic
curve over a document's greatest weight, sum and density of weights gives the score.  The curve is fitted on what each
labelled document would show if its own words had not been counted.

Scale.  Three narrow passes over the texts in Arrow batches.  The first counts n-grams of all training documents in a table of
fixed size (hashed; a row for each slot and task, summed map-side and by key), so the model's counts grow with the corpus and its
size does not.  The second restores labelled documents, and counts their features in the same way; the third scores
all documents.  The driver holds tables of at most ``ORDER << SLOT_BITS`` counts and ``1 << FEATURE_BITS`` features, and three
numbers of each of at most about ``CALIBRATION_ROWS`` labelled documents.  Texts are not shuffled while there are at most
``BROADCAST_ROWS`` labels.  A stretch has a few hypotheses a character, so a very long one takes linear time.

Defined cases.  A null text is empty; an empty one has no words and gets the score of no evidence.  A document labelled more than once
is toxic if any label says so; null labels and ids are not learned from, and null ids count as held out.  Without labelled
documents of both classes all get the share of toxic ones, 0 if there are none.  Repeated rows are scored each.  Other columns,
whatever their names, do not matter.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, repeat
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm import staging
from veilmark.llm.language_id import FOLDS, held_out
from veilmark.llm.sequences import mixed

ORDER = 5
SLOT_BITS = 18
#: How much the next shorter context counts for, in observations.
SHORTER = 2.0
FEATURE_BITS = 20
PREFIXES = (3, 4, 5)
#: Features of fewer toxic documents are not looked at; Z is how many standard errors the bound lies below the share.
LEAST_TOXIC, Z = 3, 2.5
CALIBRATION_ROWS = 20_000
#: Up to this many labels (about 20 bytes each) are sent to all tasks; beyond it the texts that have one are found by a shuffled join.
BROADCAST_ROWS = 1_000_000
#: What look-alikes stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
#: What may stand between spaced-out letters.
SEPARATORS = " .-_*~·/"
#: Log probabilities of the channel: a swap, a repetition, a letter spaced out.
SWAP, REPEAT, SPACE = -1.5, -0.7, -0.3
_SYMBOLS = "@$!|+€£¡"
_LETTER = r"[^\W\d_]"
_ONE = rf"(?:[^\W_]|[{re.escape(_SYMBOLS)}])"
_TOKEN = rf"[\w{re.escape(_SYMBOLS)}]"
#: Single characters with separators between; runs of characters of words and look-alikes; what makes such a run suspect.
SPACED = re.compile(rf"(?<!{_TOKEN}){_ONE}(?:[{re.escape(SEPARATORS)}]{{1,2}}{_ONE}){{2,}}(?!{_TOKEN})")
RUN = re.compile(rf"{_TOKEN}+")
TWICE = re.compile(r"(.)\1\1|^(?:(.)\2+){3,}$", re.S)
#: Whether TWICE finds something in any of the lines.
ANY_TWICE = re.compile(r"(.)\1\1|^(?:(.)\2+){3,}$", re.M)
_EDGES = ".,;:?'\"()[]{}<>«»“”„‘’…*#%&_-"
ODD = re.compile(rf"{_LETTER}[0-9{re.escape(_SYMBOLS)}](?=\w)|[0-9{re.escape(_SYMBOLS)}]{_LETTER}|({_LETTER})\1\1|^(?:({_LETTER})\2+){{3,}}$")
WORDS = re.compile(rf"{_LETTER}+")
_SEEDS = np.random.default_rng(20250117).integers(1, 2**63, ORDER + 1, dtype=np.uint64)
_INVISIBLE = re.compile("[\xad\u200b-\u200d\u2060\ufeff]+")
_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """Each code point of the basic plane as the language model sees it: letters, ``#`` for digits, blank for the rest."""
    if not _KINDS:
        _KINDS.append(np.array([i if chr(i).isalpha() else 35 if chr(i).isdigit() else 32 for i in range(1 << 16)], np.uint32))
    return _KINDS[0]


def plain(text: str | None) -> str:
    low = (text or "").lower()
    return low if low.isascii() else _INVISIBLE.sub("", low)


def slots(texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(order, slot of each n-gram) of the texts, one after the other, with a blank between and one blank for many."""
    codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.where(codes < 1 << 16, _kinds()[np.minimum(codes, 65535)], codes).astype(np.uint64)
    seen = seen[np.r_[True, (seen[1:] != 32) | (seen[:-1] != 32)]]
    gram = np.zeros(len(seen), np.uint64)
    with np.errstate(over="ignore"):
        for order in range(1, ORDER + 1):
            if len(seen) < order:
                return
            gram = gram[: len(seen) - order + 1] * np.uint64(0x100000001B3) + seen[order - 1 :]
            yield order, (mixed(gram + _SEEDS[order]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Characters:
    """The language model: P(character | those before it), from hashed counts."""

    def __init__(self, counts: np.ndarray, total: int) -> None:
        self.counts, self.total = counts, total
        self.known: dict[str, float] = {}

    def logp(self, gram: str) -> float:
        """Of the last character after the others, of which the last ORDER - 1 count."""
        found = self.known.get(gram)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[gram] = log(self._p(gram))
        return found

    def _p(self, gram: str) -> float:
        def count(s: str) -> float:
            h = 0
            for c in s:
                h = (h * 0x100000001B3 + ord(c)) & 0xFFFFFFFFFFFFFFFF
            x = (h + int(_SEEDS[len(s)])) & 0xFFFFFFFFFFFFFFFF
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
            return float(self.counts[len(s) - 1, (x ^ (x >> 31)) >> (64 - SLOT_BITS)])

        p = 1e-4
        for n in range(1, len(gram) + 1):
            before = count(gram[-n:-1]) if n > 1 else self.total
            p = (count(gram[-n:]) + SHORTER * p) / (max(before, count(gram[-n:])) + SHORTER)
        return p


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """For each run of one character of a stretch: what it may have stood for, with the channel's log probability."""
    parts: list[list[tuple[str, float]]] = []
    spaced = len(stretch) > 2 and stretch[1] in SEPARATORS
    for run in re.finditer(r"(.)\1*", stretch, re.S):
        c, n = run.group(1), len(run.group(0))
        if spaced and c in SEPARATORS:
            parts.append([("", SPACE), (" ", 0.0)])
        elif c.isdigit() or c in _SYMBOLS:
            own = "#" * n if c.isdigit() else " "
            letters = [(letter * k, SWAP * k + REPEAT * (k < n)) for letter in LOOK_ALIKES.get(c, "") for k in {1, min(n, 2)}]
            parts.append([(own, 0.0), *letters])
        elif n == 1 or not c.isalpha():
            parts.append([(c if c.isalpha() else " ", 0.0)])
        else:
            parts.append([(c, REPEAT), (c * 2, 0.0 if n == 2 else REPEAT)] + ([(c * n, 0.0)] if n == 3 else []))
    return parts


def decode(stretch: str, model: Characters) -> str:
    """The path through the stretch's lattice that the channel and the language model together find likeliest."""
    best: dict[str, tuple[float, tuple | None]] = {" ": (0.0, None)}
    for options in [*lattice(stretch), [(" ", 0.0)]]:
        now: dict[str, tuple[float, tuple | None]] = {}
        for context, (score, path) in best.items():
            for said, cost in options:
                after, total = context, score + cost
                for c in said:
                    if c == " " and after[-1:] == " ":
                        continue
                    total += model.logp(after + c)
                    after = (after + c)[-(ORDER - 1) :]
                if after not in now or total > now[after][0]:
                    now[after] = (total, (path, said))
        best = now
    path, out = max(best.values(), key=lambda v: v[0])[1], []
    while path is not None:
        path, said = path
        out.append(said)
    return "".join(reversed(out)).strip()


class Restorer:
    """Texts as tokens (what white space parts) with suspect ones replaced by what they are likeliest to have said.

    Of neighbouring tokens of one character each, three or more that could be letters are one stretch.  What tokens come to
    is remembered, up to ``kept`` of them.
    """

    kept = 200_000

    def __init__(self, model: Characters | None) -> None:
        self.model = model
        self.seen: dict[str, str] = {}

    def tokens(self, text: str | None) -> list[str]:
        return self.joined(plain(text).split())

    def __call__(self, text: str | None) -> str:
        return " ".join(map(self.token, self.tokens(text)))

    def joined(self, tokens: list[str]) -> list[str]:
        """Spaced-out stretches as one token each, with the blanks."""
        if self.model is None or not _three_single(tokens):
            return tokens
        sizes = list(map(len, tokens))
        out: list[str] = []
        at = 0
        while at < len(tokens):
            to = at
            while to < len(tokens) and sizes[to] == 1 and (_single(tokens[to]) or tokens[to] in SEPARATORS):
                to += 1
            while to > at and not _single(tokens[to - 1]):
                to -= 1
            if to - at >= 3 and sum(map(_single, tokens[at:to])) >= 3:
                out.append(" ".join(tokens[at:to]))
                at = to
            else:
                out += tokens[at : max(to, at + 1)]
                at = max(to, at + 1)
        return out

    def words(self, token: str) -> list[str]:
        """The words of a token, restored."""
        core = token.strip(_EDGES)
        if core.isalpha() and (self.model is None or not TWICE.search(core)):
            return [core]
        return WORDS.findall(self.token(token))

    def token(self, token: str) -> str:
        """A token, restored."""
        if self.model is None:
            return token
        found = self.seen.get(token)
        if found is None:
            found = decode(token, self.model) if " " in token else self._parts(token)
            if len(self.seen) >= self.kept:
                self.seen.clear()
            if len(token) <= 64:
                self.seen[token] = found
        return found

    def _parts(self, token: str) -> str:
        spaced = SPACED.search(token) if not token.isalpha() else None
        if spaced:
            return SPACED.sub(lambda m: decode(m.group(0), self.model), token)
        return RUN.sub(lambda m: decode(m.group(0), self.model) if ODD.search(m.group(0)) else m.group(0), token)


def _three_single(tokens: list[str]) -> bool:
    """Whether three neighbouring tokens have one character each."""
    try:
        sizes = bytes(map(len, tokens))
    except ValueError:  # one of more than 255
        sizes = bytes(len(token) == 1 for token in tokens)
    return b"\1\1\1" in sizes


def _single(token: str) -> bool:
    return len(token) == 1 and (token.isalnum() or token in _SYMBOLS)


def features(word: str) -> list[int]:
    """Slots of the word and of its prefixes, the shortest first."""
    data = [word + "\0", *(word[:n] for n in PREFIXES if len(word) >= n)]
    return [crc32(d.encode("utf-8", "surrogatepass")) & (1 << FEATURE_BITS) - 1 for d in data]


def begins(word: str) -> int:
    """The slot of a word's first feature but the word itself, or of the word if it has no other."""
    return crc32((word[: PREFIXES[0]] if len(word) >= PREFIXES[0] else word + "\0").encode("utf-8", "surrogatepass")) & (1 << FEATURE_BITS) - 1


def weights(n: np.ndarray, toxic: np.ndarray, base: float) -> np.ndarray:
    """Log odds, over those of the base, of the lower bound of the toxic share; 0 where there is no evidence."""
    known = (toxic >= LEAST_TOXIC) & (n > 0)
    n = np.maximum(n, 1).astype(float)
    share = np.clip(toxic / n, 0, 1)
    low = (share + Z * Z / (2 * n) - Z * np.sqrt((share * (1 - share) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
    low = np.where(known & (low > base), low, base)
    return np.log(low / (1 - low)) - np.log(base / (1 - base))


def _evidence(found: list[float], size: int) -> tuple[float, float, float]:
    """(greatest weight, log of the sum, sum a hundred tokens) of the weights of a document's different words."""
    return (max(found), log(1 + sum(sorted(found))), min(10.0, 100 * sum(sorted(found)) / size)) if found else (0.0, 0.0, 0.0)


class Model:
    """The language model, the weights of features that have one, how words with a weight begin, and the curve."""

    def __init__(self, characters: Characters | None, base: float, weights: dict[int, float] | None = None, starts: Iterable[int] = (), curve: np.ndarray | None = None) -> None:
        self.characters, self.base, self.weights, self.starts, self.curve = characters, base, weights or {}, frozenset(starts), curve

    def weight(self, word: str) -> float:
        """The greatest weight of a word's features; only words that begin as one with a weight does have any."""
        return max(map(self.weights.get, features(word), repeat(0.0))) if begins(word) in self.starts else 0.0

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(evidence), self.base)
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(evidence)), evidence] @ self.curve, -40, 40)))


class Reader:
    """Evidence of texts under a model; which tokens have been looked at, and what words with a weight they hold, is remembered."""

    kept = 400_000

    def __init__(self, model: Model) -> None:
        self.model, self.restore = model, Restorer(model.characters)
        self.restore.kept = 20_000  # tokens that come back are known here already
        self.seen: set[str] = set()
        self.weighty: set[str] = set()
        self.heavy: dict[str, list[tuple[str, float]]] = {}
        self.may: dict[str, bool] = {}

    def weight(self, word: str) -> float:
        """The word's weight; how it begins is looked up first, and remembered."""
        start = word[: PREFIXES[0]]
        known = self.may.get(start)
        if known is None:
            if len(self.may) > 100_000:
                self.may.clear()
            known = self.may[start] = begins(word if len(word) < PREFIXES[0] else start) in self.model.starts
        return self.model.weight(word) if known else 0.0

    def look(self, tokens: set[str]) -> None:
        """Note which tokens hold words with a weight.

        Most are a word that begins as none with a weight does: these need no more than a look at how they begin.
        """
        cores = [token.strip(_EDGES) for token in tokens]
        twice = self.model.characters is not None and ANY_TWICE.search("\n".join(cores)) is not None
        may, weight, n = self.may, self.weight, PREFIXES[0]
        for token, core in zip(tokens, cores):
            if core.isalpha() and not (twice and TWICE.search(core)):
                if may.get(core[:n]) is False:
                    continue
                words = [core]
            else:
                words = WORDS.findall(self.restore.token(token))
            found = [(word, w) for word in words if (w := weight(word))]
            if found:
                self.heavy[token] = found
                self.weighty.add(token)

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        tokens = self.restore.tokens(text)
        own = set(tokens)
        new = own - self.seen
        if new:
            self.look(new)
            self.seen |= new
        words = dict(chain.from_iterable(map(self.heavy.__getitem__, own & self.weighty)))
        if len(self.seen) > self.kept:
            self.seen, self.weighty, self.heavy = set(), set(), {}
        return _evidence(list(words.values()), len(tokens))


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps, halved where they would not help."""
    x = np.c_[np.ones(len(x)), x]
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-9] + [ridge] * (x.shape[1] - 1))
    loss = lambda b: float(np.logaddexp(0, x @ b).sum() - y @ (x @ b) + b @ penalty @ b / 2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(beta)), x.T @ (y - p) - penalty @ beta)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return beta


def characters(docs: DataFrame, text: str = "text") -> Characters | None:
    """The language model of all texts of docs; None where there is no character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((ORDER, 1 << SLOT_BITS), np.int64)
        for batch in batches:
            held: list[str] = []
            size = 0
            for value in [*batch.column(0), None]:
                if value is not None:
                    held.append(plain(value.as_py()))
                    size += len(held[-1])
                if held and (value is None or size > 1 << 20):
                    for order, at in slots(held):
                        found[order - 1] += np.bincount(at, minlength=1 << SLOT_BITS)
                    held, size = [], 0
        order, slot = np.nonzero(found)
        for at in range(0, len(slot), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array((order[part] << SLOT_BITS) + slot[part], pa.int32()), pa.array(found[order[part], slot[part]])], ["slot", "n"])

    counted = docs.select(docs[text].alias("text")).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # of at most ORDER << SLOT_BITS rows
    counts = np.zeros(ORDER << SLOT_BITS, np.float32)
    counts[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    counts = counts.reshape(ORDER, -1)
    total = int(counts[0].sum())
    return Characters(counts, total) if total else None


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", language: DataFrame | None = None) -> Model:
    """Learn from labelled docs; the language model is that of ``language``, by default all of docs."""
    spark = docs.sparkSession
    model = characters(docs if language is None else language, text)
    marks = labels.filter(labels[label].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.max((labels[label] != 0).cast("int")).alias("y"))
    marks = staging.stage(marks, "marks")
    few = marks.count() <= BROADCAST_ROWS
    known = docs.select(docs[id_col].alias("id"), docs[text].alias("text")).join(F.broadcast(marks) if few else marks, "id").select("y", "text", F.xxhash64("id", F.lit("curve")).alias("draw"))
    shared = spark.sparkContext.broadcast(model)
    size = 1 << FEATURE_BITS

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's number of tokens, the slots of its different words, a word after the other, and how many each has."""
        restore = Restorer(shared.value)
        kept: dict[str, list[bytes]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows: list[tuple[int, bytes, bytes]] = []
                for value in part.column(1):
                    tokens = restore.tokens(value.as_py())
                    own = set(tokens)
                    for token in [t for t in own if t not in kept]:
                        kept[token] = [array("i", features(w)).tobytes() for w in restore.words(token)]
                    words = dict.fromkeys(chain.from_iterable(map(kept.__getitem__, own)))
                    rows.append((len(tokens), b"".join(words), bytes([len(w) // 4 for w in words])))
                    if len(kept) > 200_000:
                        kept.clear()
                columns = zip(*rows) if rows else ((), (), ())
                made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *made], ["y", "draw", "tokens", "slots", "sizes"])

    seen = staging.stage(known.mapInArrow(restored, "y int, draw long, tokens long, slots binary, sizes binary"), "restored")

    def numbers(value: pa.Scalar, kind: type) -> np.ndarray:
        return np.frombuffer(value.as_buffer(), kind)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, toxic = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for y, slots_ in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.unique(numbers(slots_, np.int32))
                n[own] += 1
                toxic[own] += y
        at = np.flatnonzero(n)
        for low in range(0, len(at), 1 << 16):
            part = at[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n[part]), pa.array(toxic[part])], ["slot", "n", "t"])

    total, toxic = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < toxic < total:
        return Model(model, toxic / total if total else 0.0)
    base = toxic / total
    table = seen.select("y", "slots").mapInArrow(counted, "slot int, n long, t long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).filter(F.col("t") >= LEAST_TOXIC).toArrow()
    at, n, t = (table.column(c).to_numpy() for c in ("slot", "n", "t"))
    worth = weights(n, t, base)
    heavy = at[worth > 0]
    sent = spark.sparkContext.broadcast(heavy)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How words begin that have a feature with a weight."""
        has = np.zeros(size, bool)
        has[sent.value] = True
        found = np.zeros(size, bool)
        for batch in batches:
            for slots_, sizes in zip(batch.column(0), batch.column(1)):
                own, lengths = numbers(slots_, np.int32), numbers(sizes, np.uint8).astype(np.int64)
                if len(own):
                    first = np.r_[0, np.cumsum(lengths)[:-1]]
                    some = np.logical_or.reduceat(has[own], first)
                    found[own[first + (lengths > 1)][some]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found), pa.int32())], ["slot"])

    starts = seen.select("slots", "sizes").mapInArrow(begun, "slot int").distinct().toArrow().column("slot").to_pylist()
    out = Model(model, base, {int(slot): float(w) for slot, w in zip(at, worth) if w > 0}, starts)
    counts = spark.sparkContext.broadcast((at, n, t))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Evidence of each document as if it had not been learned from."""
        at, n, t = counts.value
        every_n, every_t = np.zeros(size, np.int64), np.zeros(size, np.int64)
        every_n[at], every_t[at] = n, t
        for batch in batches:
            found = []
            for y, tokens, slots_, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                own, lengths = numbers(slots_, np.int32), numbers(sizes, np.uint8).astype(np.int64)
                if not len(own):
                    found.append((0.0, 0.0, 0.0))
                    continue
                worth = weights(every_n[own] - 1, every_t[own] - y, base)
                best = np.maximum.reduceat(worth, np.r_[0, np.cumsum(lengths)[:-1]])
                found.append(_evidence(best[best > 0].tolist(), tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in (zip(*found) if found else ((), (), ())))], ["y", "a", "b", "c"])

    drawn = seen.filter(F.pmod("draw", F.lit(1 << 20)) < F.lit(min(1.0, CALIBRATION_ROWS / total) * (1 << 20)))
    rows = np.array([tuple(r) for r in drawn.select("y", "tokens", "slots", "sizes").mapInArrow(measured, "y int, a double, b double, c double").orderBy("y", "a", "b", "c").collect()]).reshape(-1, 4)
    if 0 < rows[:, 0].sum() < len(rows):
        out.curve = _curve(rows[:, 1:], rows[:, 0])
    return out


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per row of docs: doc_id, held_out, score, predicted."""
    own = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = Reader(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = np.array([reader.evidence(t.as_py()) for t in part.column(2)]).reshape(-1, 3)
                value = model.score(found)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def restored(docs: DataFrame, model: Characters | None, text: Column | str = "text") -> Column:
    """The text, in lower case and with one blank for white space, with suspect stretches decoded."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        restore = Restorer(shared.value)
        return pa.array([restore(t.as_py()) for t in texts], pa.string())

    return run(docs[text] if isinstance(text, str) else text)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by what those outside the held-out fold teach."""
    return score(docs, fit(docs.filter(~held_out(docs["doc_id"], FOLDS)), labels))
