"""Texts that were decoded with a wrong character encoding: finding and restoring them.

1. *Twins.* Texts are cut into segments. Segments that are equal once all non-ASCII characters are taken out are twins; of each set of
   twins every variant is aligned with the one that most documents have, run of non-ASCII characters by run.
2. *Transformations.* An aligned pair of runs is explained by the pairs of encodings (true, wrong) that turn the one into the other; the
   smallest set of such pairs that explains the aligned runs, each of them with enough support, is what the corpus has taught.
3. *Application.* The learned transformations are undone in all texts, run by run, where the result is text that the corpus finds
   likelier. Likelihood comes from counts of character pairs over all documents, kept in a table of fixed size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


#: Encodings that texts may truly have had, and that they may have been read in.
TRUE = ("utf_8", "cp1252", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "mac_roman", "cp850", "cp437", "cp1250", "euc_jp", "shift_jis", "gb18030", "big5", "euc_kr")
WRONG = ("cp1252", "latin_1", "cp1250", "cp1251", "iso8859_15", "iso8859_5", "koi8_r", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp852", "cp866", "cp1253", "cp1254", "cp1257")
#: Distinct aligned runs that a transformation needs to be learned.
SUPPORT = 3
#: ASCII characters that twins share at least.
SKELETON = 12
#: Digits and signs that twins in which ASCII letters may be misread share at least.
DENSE_SKELETON = 8
#: Buckets of the table of character pairs: 2 MB, whatever the corpus.
BUCKETS = 1 << 18
#: How much likelier (log, a character pair on average) a restored run must be: from UTF-8, whose bytes check themselves, so that it may even be rarer, and from others.
GAIN_UTF8, GAIN_OTHER = -2.0, 2.0

_MARK = "�"


class Single:
    """A single-byte encoding; bytes that it leaves undefined stand for the control characters of the same number."""

    def __init__(self, name: str):
        self.chars = []
        for b in range(256):
            try:
                self.chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                self.chars.append(chr(b))
        self.bytes = {c: b for b, c in reversed(list(enumerate(self.chars)))}

    def encode(self, text: str) -> bytes | None:
        try:
            return bytes(map(self.bytes.__getitem__, text))
        except KeyError:
            return None

    def decode(self, data: bytes) -> str:
        return "".join(map(self.chars.__getitem__, data))


_SINGLES = {name: Single(name) for name in WRONG}


def explanations(clean: str, garbled: str) -> list[str]:
    """The pairs ``true>wrong`` of encodings by which ``clean``, written in the one and read in the other, became ``garbled``."""
    read = {}
    for wrong in WRONG:
        data = _SINGLES[wrong].encode(garbled)
        if data is not None:
            read.setdefault(data, []).append(wrong)
    found = []
    for true in TRUE:
        try:
            data = clean.encode(true)
        except UnicodeEncodeError:
            continue
        found += [f"{true}>{wrong}" for wrong in read.get(data, ()) if wrong != true]
    return found


def cover(signatures: list[tuple[str, int, int]]) -> list[str]:
    """Transformations that explain the aligned runs, most-explaining first.

    ``signatures``: (transformations that explain a run, space-separated; number of distinct runs where the misread side has fewer
    documents; number where it is a tie, which has the transformations of both directions and counts half).
    """
    left = [(set(s.split(" ")), 2 * n + t) for s, n, t in signatures]
    learned: list[str] = []
    order = {f"{a}>{b}": i for i, (a, b) in enumerate((a, b) for a in TRUE for b in WRONG)}
    while True:
        votes = Counter()
        for s, n in left:
            for x in s:
                votes[x] += n
        best = min(votes, key=lambda x: (-votes[x], order.get(x, 0)), default=None)
        if best is None or votes[best] < 2 * SUPPORT:
            return learned
        left = [(s, n) for s, n in left if best not in s]
        learned.append(best)


def twin_runs(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Aligned runs of twins: clean, garbled, n (documents with the garbled side), tie (as many have the clean side)."""
    beyond = lambda c: F.octet_length(c) - F.length(c)  # noqa: E731  0 for ASCII, one to three for each other character
    segments = documents.where(beyond(F.col(text)) > 0).select(F.explode(F.split(F.col(text), r"[\r\n]+|(?<=[.;:])\s+")).alias("segment")).where(beyond(F.col("segment")) > 0)
    part = lambda kept: F.struct(F.regexp_replace("segment", f"[^{kept}]+", "").alias("skeleton"), F.regexp_replace("segment", f"[\\x00-\\x20{kept}]+", "\u0001").alias("runs"))
    # some encodings use ASCII letters as second bytes, but no digits or points: lines that are mostly not ASCII are compared by those as well
    foreign = beyond(F.col("segment")) * 2 > F.length("segment")
    plain = segments.select(F.explode(F.array_compact(F.array(part(r"\x21-\x7e"), F.when(foreign, part(r"\x21-\x3f"))))).alias("p"), "segment")
    parts = plain.select("p.*").where(F.length("skeleton") >= F.when(F.col("skeleton").rlike("[@-~]"), SKELETON).otherwise(DENSE_SKELETON))
    # copies collapse before anything is compared; each variant meets only the commonest one of its twins
    variants = parts.groupBy(F.xxhash64("skeleton").alias("twin"), F.xxhash64("skeleton", F.lit(1)).alias("twin2"), "runs").agg(F.count("*").alias("n"))
    most = variants.groupBy("twin", "twin2").agg(F.max(F.struct("n", "runs")).alias("top"), F.count("*").alias("of")).where("of > 1")
    pairs = variants.join(most, ["twin", "twin2"]).where("runs <> top.runs")
    zipped = pairs.select(F.split("top.runs", "\u0001").alias("a"), F.split("runs", "\u0001").alias("b"), "n", (F.col("n") == F.col("top.n")).alias("tie")).where(F.size("a") == F.size("b"))
    runs = zipped.select(F.explode(F.arrays_zip("a", "b")).alias("x"), "n", "tie").where("x.a <> x.b and x.a <> '' and x.b <> ''")
    return runs.groupBy(F.col("x.a").alias("clean"), F.col("x.b").alias("garbled")).agg(F.sum("n").alias("n"), F.min("tie").alias("tie"))


def learn(documents: DataFrame, key: str = "doc_id", text: str = "text") -> list[str]:
    """The transformations ``true>wrong`` that the twins of the corpus teach."""

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for c, g, tie in zip(*(x.to_pylist() for x in batch.columns)):
                for x, y in ((c, g), (g, c)) if tie else ((c, g),):
                    if signature := " ".join(sorted(explanations(x, y))):
                        found[signature, tie] += 1
            yield pa.RecordBatch.from_pylist([{"signature": s, "n": 0 if t else n, "ties": n if t else 0} for (s, t), n in found.items()], schema=pa.schema([("signature", pa.string()), ("n", pa.int64()), ("ties", pa.int64())]))

    signatures = twin_runs(documents, key, text).select("clean", "garbled", "tie").mapInArrow(explain, "signature string, n long, ties long").groupBy("signature").agg(F.sum("n").alias("n"), F.sum("ties").alias("ties"))
    return cover([(r.signature, r.n, r.ties) for r in signatures.toLocalIterator()])  # as many rows as sets of encodings, not as runs


# --- how likely text is ---------------------------------------------------------------------------------------------------


#: ASCII as the counts see it: all digits are alike, and so are all signs and blanks.
_FOLDED = np.array([48 if 48 <= i <= 57 else i if chr(i).isalpha() else 32 for i in range(128)], np.uint32)

_FOLDED_LIST = _FOLDED.tolist()


def _pairs_of(text: str) -> np.ndarray:
    """Buckets of the adjacent characters of ``text`` of which one at least is not ASCII."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = points < 128
    if plain.all():
        return points[:0]
    use = np.flatnonzero(~(plain[:-1] & plain[1:]))
    a, b = points[use], points[use + 1]
    a, b = np.where(a < 128, _FOLDED[np.minimum(a, 127)], a), np.where(b < 128, _FOLDED[np.minimum(b, 127)], b)
    return _bucket(a, b)


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))) >> np.uint32(14)


def likelihoods(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Log of one more than the count of each bucket of character pairs over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for i in range(0, len(texts), 400):
                total += np.bincount(_pairs_of("\n".join(texts[i : i + 400])), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    sums = documents.select(text).where(F.col(text).isNotNull()).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = np.zeros(BUCKETS, np.float32)
    for r in sums.toLocalIterator():  # at most BUCKETS rows
        table[r.bucket] = math.log1p(r.n)
    return table


# --- undoing --------------------------------------------------------------------------------------------------------------


class Restorer:
    """Undoes learned transformations in single texts."""

    RUN = re.compile(r"[^\x00-\x7f]+")
    #: A run in a text of mostly other characters than ASCII, where ASCII letters may be second bytes.
    DENSE = re.compile(r"(?:[@-~]?[^\x00-\x7f]){3,}[@-~]?")
    #: What a text about such sequences puts around them.
    QUOTED = re.compile("[\"'“„‘«”`]\\s?$")
    WORD_BEFORE, WORD_AFTER = re.compile(r"[A-Za-z]+\Z"), re.compile(r"[A-Za-z]+")
    #: Control characters, which no text has but for the line end.
    CONTROLS = re.compile("[\x80-\x84\x86-\x9f]")
    UNQUOTED = re.compile("^\\s?[\"'”“’»`]")

    def __init__(self, learned: list[str], table: np.ndarray):
        pairs = [tuple(x.split(">")) for x in learned]
        self.steps = [(true, _SINGLES[wrong]) for true, wrong in sorted(pairs, key=lambda p: p[0] != "utf_8")]
        self.table, self.listed = table, table.tolist()
        self.wide = [(true, wrong) for true, wrong in self.steps if true in ("shift_jis", "gb18030", "big5")]
        self.multibyte = [(true, wrong) for true, wrong in self.steps if true in ("euc_jp", "shift_jis", "gb18030", "big5", "euc_kr")]
        self.proving = [step for step in self.steps if step[0] == "utf_8"]
        self.maybe: dict[str, int] = {}
        self.known: dict[tuple[str, str, str], str | None] = {}

    def score(self, text: str) -> float:
        """Mean log count of the character pairs of ``text`` that aren't ASCII."""
        if len(text) < 64:  # the same sum without numpy, which is slow on few characters
            points = [p if p > 127 else _FOLDED_LIST[p] for p in map(ord, text)]
            found = [self.listed[(a * 0x9E3779B1 ^ b * 0x85EBCA77) >> 14 & (BUCKETS - 1)] for a, b in zip(points, points[1:]) if a > 127 or b > 127]
            return sum(found) / len(found) if found else 0.0
        b = _pairs_of(text)
        return float(self.table[b].mean()) if len(b) else 0.0

    def _once(self, run: str, left: str, right: str, steps: list, base: float) -> tuple[str, float, bool] | None:
        """The likeliest text of which one learned transformation made ``run``, its gain over ``base`` and whether it is enough; None if there is none.

        Text that its bytes prove to be UTF-8 is offered whatever its gain, as it may be misread text again.
        """
        best = None
        for true, wrong in steps:
            data = wrong.encode(run)
            if data is None:
                continue
            utf8 = true == "utf_8"
            try:
                text = data.decode(true)
            except UnicodeDecodeError:
                if not utf8:
                    continue
                text = data.decode(true, "replace")
                lost = text.count(_MARK)
                if lost * 3 > len(text) or len(text) < 4:
                    continue
            if text == run or not text or any(0x80 <= ord(c) < 0xA0 for c in text) and not utf8:
                continue
            gain = self.score(left + text.replace(_MARK, "") + right) - base
            enough = gain >= GAIN_UTF8 if utf8 else gain >= GAIN_OTHER and sum(c > "\x7f" for c in run) >= 3
            if (utf8 or enough) and (best is None or (enough, utf8, gain) > (best[2], best[3], best[1])):
                best = text, gain, enough, utf8
        return best and best[:3]

    def run(self, run: str, left: str = " ", right: str = " ", steps: list | None = None) -> str | None:
        """``run`` restored, or None if it is no misread text."""
        key = run, left, right
        if steps is not None or key not in self.known:
            text, found, most, base = run, None, -math.inf, self.score(left + run + right)
            seen = {text}  # a text may have been misread over and over; encodings of single bytes can lead back to where they began
            while (step := self._once(text, left, right, self.steps if steps is None else steps, base)) is not None and step[0] not in seen:
                text, gain, enough = step
                seen.add(text)
                if enough and gain >= most:
                    found, most = text, gain
            if steps is not None:
                return found
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[key] = found
        return self.known[key]

    @staticmethod
    def _beside(c: str) -> str:
        return "0" if c.isdigit() else c if c.isalnum() else " "

    def _runs(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Places of misread runs and what they were."""
        wide: list[tuple[int, int, str]] = []
        if self.wide and (len(text.encode("utf-8", "replace")) - len(text)) * 2 > len(text):
            for m in self.DENSE.finditer(text):
                if not m.group().isascii() and any(wrong.encode(m.group()[:20]) is not None for _, wrong in self.wide):
                    for a, b in ((m.start(), m.end()), (m.start(), m.end() - 1), (m.start() + 1, m.end()), (m.start() + 1, m.end() - 1)):
                        new = self.run(text[a:b], steps=self.wide) if b - a > 4 else None
                        if new is not None:
                            wide.append((a, b, new))
                            break
        wide = self._rest(text, wide)
        gaps = self._gaps(text, wide)
        plain = list(self._plain(text, gaps)) if any(self._possible(run) for run in {r for a, b in gaps for r in self.RUN.findall(text, a, b)}) else []
        # what the other encodings of several bytes were found in is looked through for their short runs as well
        yield from self._rest(text, sorted(wide + plain)) if plain and self.multibyte else sorted(wide + plain)

    @staticmethod
    def _gaps(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
        """What of ``text`` lies between the places ``found``."""
        ends = [0, *(x for a, b, _ in found for x in (a, b)), len(text)]
        return [(a, b) for a, b in zip(ends[::2], ends[1::2]) if a < b]

    def _rest(self, text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """``found`` and, in the rest of the text, the runs of any length that the same encodings of several bytes make likelier."""
        for step in self.multibyte:
            if any(self._undone(text[a:b], step) == new for a, b, new in found):
                more = [x for a, b in self._gaps(text, found) for x in self._stretches(text, a, b, step)]
                found = sorted(found + [x for x in more if self._likelier(text, *x) and self.run(text[x[0] : x[1]], steps=self.proving) is None])
        return found

    @staticmethod
    def _undone(run: str, step: tuple) -> str | None:
        try:
            data = step[1].encode(run)
            return data and data.decode(step[0])
        except UnicodeDecodeError:
            return None

    def _stretches(self, text: str, start: int, end: int, step: tuple) -> Iterator[tuple[int, int, str]]:
        """The longest runs of whole characters of ``step`` that begin with a sign beyond ASCII, and what they were."""
        at, out, i = start, [], start
        while i < end:
            one = next(((k, c) for k in range(1, 5) if i + k <= end and (c := self._undone(text[i : i + k], step)) is not None and len(c) == 1), None) if text[i] > "\x7f" else None
            if one is not None and not 0x80 <= ord(one[1]) < 0xA0:
                out.append(one[1])
                i += one[0]
                continue
            if out:
                yield at, i, "".join(out)
            i += 1
            at, out = i, []
        if out:
            yield at, end, "".join(out)

    def _likelier(self, text: str, start: int, end: int, new: str) -> bool:
        left, right = self._beside(text[start - 1]) if start else " ", self._beside(text[end]) if end < len(text) else " "
        return self.score(left + new + right) > self.score(left + text[start:end] + right)

    def _plain(self, text: str, gaps: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
        """Places of misread runs of signs beyond ASCII in ``gaps`` and what they were."""
        found: list[tuple[int, int, str, str | None]] = []
        steps = set()
        for m in (m for a, b in gaps for m in self.RUN.finditer(text, a, b)):
            run = m.group()
            possible = self._possible(run)
            left, right = " ", " "
            new = None
            if possible == 2:
                left, right = self._beside(text[m.start() - 1]) if m.start() else " ", self._beside(text[m.end()]) if m.end() < len(text) else " "
            if possible:
                new = self.run(run, left, right)
                if new is not None and len(run) == len(new) and (step := self._step_of(run, new)) is not None:
                    steps.add(step)
            found.append((m.start(), m.end(), run, new))
        # the rest of a text in which some words were misread letter by letter was so too, where that makes it likelier
        for start, end, run, new in found:
            if new is None and steps:
                base = self.score(f" {run} ")
                for step in steps:
                    data = step[1].encode(run)
                    other = data.decode(step[0], "replace") if data is not None else run
                    if other != run and other.isalpha() == run.isalpha() and (gain := self.score(f" {other} ") - base) > 0:
                        new, base = other, base + gain
            if new is not None:
                yield start, end, new

    def _step_of(self, run: str, new: str) -> tuple | None:
        """The letter-by-letter transformation that made ``run`` of ``new``; None if it was another kind."""
        for true, wrong in self.steps:
            if true not in ("utf_8", "euc_jp", "shift_jis", "gb18030", "big5", "euc_kr") and (data := wrong.encode(run)) is not None and data.decode(true, "replace") == new:
                return true, wrong
        return None

    #: Runs that, where their bytes prove nothing, are long enough to be judged without their neighbours.
    ALONE = 4

    def _possible(self, run: str) -> int:
        """Whether ``run`` is misread text (1), may be, depending on what stands beside it (2), or is not (0)."""
        known = self.maybe.get(run)
        if known is None:
            if len(self.maybe) > 300_000:
                self.maybe.clear()
            if any(self._once(run, " ", " ", [step], -math.inf) is not None for step in (self.proving if len(run) >= self.ALONE else self.steps)):
                known = 2
            else:
                known = int(len(run) >= self.ALONE and self.run(run) is not None)
            self.maybe[run] = known
        return known

    def _left(self, text: str, new: str, found: list[tuple[int, int, str]]) -> bool:
        """Whether ``new``, made of ``text`` by ``found``, still has misread signs: control characters, or runs of more signs than agree by chance that a learned transformation explains."""
        if self.CONTROLS.search(new) or any(m.end() - m.start() > 2 and self._undone(m.group(), step) is not None and not self._quoted(new, m.start(), m.end()) for step in self.proving for m in self.RUN.finditer(new)):
            return True
        used = [step for step in self.multibyte if any(self._undone(text[a:b], step) == c for a, b, c in found)]
        return any(len(c) < b - a and not self._quoted(text, a, b) for step in used for x, y in self._gaps(text, found) for a, b, c in self._stretches(text, x, y, step))

    def text(self, text: str) -> tuple[str, int, int, int, bool]:
        """The restored text, the runs restored, those of them that the text only quotes, the marks of lost characters outside of quotes, and whether misread signs are left."""
        out, at, done, quoted = [], 0, 0, 0
        found = list(self._runs(text))
        for start, end, new in found:
            done += 1
            if self._quoted(text, start, end):
                quoted += 1
                continue
            out += [text[at:start], new]
            at = end
        lost = sum(not (self._quoted(text, m.start(), m.end()) or text[m.start() - 1 : m.start()] + text[m.end() : m.end() + 1] == "()") for m in re.finditer(_MARK + "+", text)) if _MARK in text else 0
        new = "".join([*out, text[at:]])
        return new, done, quoted, lost, done > quoted and self._left(text, new, found)

    def _quoted(self, text: str, start: int, end: int) -> bool:
        """Whether the word around a run stands in quotation marks by itself."""
        before, after = self.WORD_BEFORE.search(text, max(0, start - 40), start), self.WORD_AFTER.match(text, end, end + 40)
        start, end = before.start() if before else start, after.end() if after else end
        return bool(self.QUOTED.search(text[max(0, start - 2) : start]) and self.UNQUOTED.search(text[end : end + 2]))


RESTORED = "key {}, garbled boolean, restored boolean, runs int, text string"


def restore(documents: DataFrame, key: str = "doc_id", text: str = "text", changed_only: bool = False) -> DataFrame:
    """``key``, ``garbled`` (a part of the text was misread), ``restored`` (nothing misread or lost is left), ``runs`` and ``text`` as restored.

    Null, empty and blank texts and texts of ASCII only aren't garbled and stay as they are. A text that only quotes such sequences
    isn't garbled. Without twins nothing is learned, and only texts with marks of lost characters are garbled. With ``changed_only``
    just the garbled rows come out.
    """
    source = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    learned = learn(source, "key", "text")
    shared = documents.sparkSession.sparkContext.broadcast((learned, likelihoods(source)))  # 2 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(*shared.value)
        for batch in batches:
            out = []
            for ident, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t is None or t.isascii():
                    if not changed_only:
                        out.append((ident, False, False, 0, t))
                    continue
                new, runs, quoted, lost, left = restorer.text(t)
                garbled = runs > quoted or lost > 0
                if garbled or not changed_only:
                    out.append((ident, garbled, garbled and not lost and not left and _MARK not in new, runs - quoted, new))
            columns = list(zip(*out)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, (batch.column(0).type, pa.bool_(), pa.bool_(), pa.int32(), pa.string()))], names=["key", "garbled", "restored", "runs", "text"])

    kind = documents.schema[key].dataType.simpleString()
    return source.mapInArrow(run, RESTORED.format(kind)).withColumnRenamed("key", key)


def found(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` of each document of whose text at least a part was misread."""
    return restore(documents, key, text, changed_only=True).where("garbled").select(key)
