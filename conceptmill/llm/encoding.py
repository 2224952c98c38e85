"""Find and restore text that was decoded with the wrong character encoding."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of each of the two rows of hashed n-gram counts, which bound the model (and what is broadcast) at any corpus size.
BUCKETS = 1 << 20
#: One record in so many is held out for the margin.
HELD_OUT = 10
#: Encodings in which bytes may have been read; a byte without a character there reads as the control character of its number.
READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp866", "koi8_r", "iso8859_2", "iso8859_15", "iso8859_5"]
#: Wrong readings in a row that are undone.
MAX_STEPS = 4
#: Log-probabilities of a step, against no step: UTF-8 proves itself by its form, other encodings do not.
STEP_UTF8, STEP_OTHER, STEP_OTHER_FIRST = -1.0, -6.0, -12.0
#: Counts and probabilities of n-grams, and judged forms, that a task keeps at hand; more are worked out again.
REMEMBERED = 400_000
#: Slices of the counters, and how many partitions' slices are added up at a time.
SLICES, FAN_IN = 32, 64
#: Gain beyond which a record is left out of the second training.
DOUBTFUL = 2.0
#: Sentence punctuation around a word form, no evidence for a single-byte encoding.
PUNCTUATION = ".,!?;:…\"'()[]–—“”„«»‹›-/*"
LOST = "�"
CONTROL = re.compile("[\x80-\x9f]")
TOKEN = re.compile("[^ \t\n\r]+")
FOREIGN = re.compile("[^\x00-\x7f]")
MARKUP = re.compile("<[^<>]*>")
RUN = re.compile("[^\x00-\x7f]+")


@lru_cache(maxsize=None)
def _tables(name: str) -> tuple[dict[str, int], str]:
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back = {c: b for b, c in enumerate(chars)}
    if name in ("cp1252", "cp1250", "cp1251"):  # readers of these pass unused bytes through
        for b in range(128, 160):
            back.setdefault(chr(b), b)
    return back, "".join(chars)


def core(form: str) -> str:
    """What of a form is scored: lower case, without sentence punctuation around it, markup and no-break spaces as spaces; punctuation alone stays."""
    word = form.strip(PUNCTUATION) or form
    if "<" in word:
        word = MARKUP.sub(" ", word)
    return word.replace("\xa0", " ").lower()


class Remembered(dict):
    """What ``made`` returns for each key, kept for the keys asked for; beyond REMEMBERED keys all are forgotten."""

    def __init__(self, made: Callable):
        super().__init__()
        self.made = made

    def __missing__(self, key):
        if len(self) > REMEMBERED:
            self.clear()
        self[key] = value = self.made(key)
        return value


def to_bytes(text: str, name: str) -> bytes | None:
    back = _tables(name)[0]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


def misread(text: str, written: str, read: str) -> str:
    """``text`` written in one encoding and read in another, lost characters as U+FFFD."""
    data = text.encode("utf-8") if written == "utf-8" else to_bytes(text, written)
    if data is None:
        return text
    if read == "utf-8":
        return data.decode("utf-8", "replace")
    table = _tables(read)[1]
    return "".join(table[b] for b in data)


#: A lost character misread again, which no author writes; that of ISO 8859-5 is Cyrillic letters and proves nothing by itself.
UNPROVEN = "iso8859_5"
LOST_READ = re.compile("|".join(sorted({re.escape(misread(LOST, "utf-8", n)) for n in READ_AS if n != UNPROVEN})))

_TWO = re.compile("[^\x00-\x7f]{2}")
#: Bytes of UTF-8 sequences: leading ones of two, three and four bytes, and following ones.
_LEADING, _FOLLOWING = [(0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3)], (0x80, 0xBF)


@lru_cache(maxsize=None)
def _sequence_of(name: str) -> re.Pattern:
    """The UTF-8 sequences as they look when read in an encoding."""
    back = _tables(name)[0]
    among = lambda low, high: "[" + "".join(re.escape(c) for c, b in back.items() if low <= b <= high) + "]"
    return re.compile("|".join(f"{among(low, high)}{among(*_FOLLOWING)}{{{n}}}" for low, high, n in _LEADING))


def _sequences(text: str, name: str) -> Iterator[tuple[int, int, str]]:
    """Begin, end and character of each UTF-8 sequence of a text read in an encoding."""
    back = _tables(name)[0]
    for m in _sequence_of(name).finditer(text):
        try:
            yield m.start(), m.end(), bytes(back[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            pass


def _undo_utf8(text: str) -> dict[str, str]:
    """Texts with every UTF-8 sequence decoded, each with the encoding it was read in.

    Characters that are no part of a sequence stay, so a word may be garbled in places.
    """
    out: dict[str, str] = {}
    if not _TWO.search(text):
        return out
    for name in READ_AS:
        y, at = [], 0
        for begin, end, char in _sequences(text, name):
            y += [text[at:begin], char]
            at = end
        if at:
            out.setdefault("".join([*y, text[at:]]), name)
    out.pop(text, None)
    return out


def _sequence_interiors(run: str) -> set[int]:
    """Positions inside a UTF-8 sequence that some chain of readings has there, at any of its steps."""
    inside: set[int] = set()
    seen = {run}
    frontier = {run: list(range(len(run) + 1))}  # where each character begins in the run
    for _ in range(MAX_STEPS):
        onward: dict[str, list[int]] = {}
        for text, begins in frontier.items():
            for name in READ_AS:
                y, at, kept = [], 0, []
                for begin, end, char in _sequences(text, name):
                    inside.update(range(begins[begin] + 1, begins[end]))
                    y += [text[at:begin], char]
                    kept += begins[at : begin + 1]
                    at = end
                decoded = "".join([*y, text[at:]])
                if at and decoded not in seen:
                    seen.add(decoded)
                    onward[decoded] = kept + begins[at:]
        frontier = onward
    return inside


def _pieces(form: str) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of other than ASCII characters with its surroundings; runs of over 300 are cut, but never inside a UTF-8 sequence."""
    at = 0
    for m in RUN.finditer(form):
        begin, end = max(at, m.start() - 8), m.start()
        if m.end() - m.start() > 300:
            inside = _sequence_interiors(m.group())
            for cut in range(1, m.end() - m.start()):
                if m.start() + cut - end >= 300 and cut not in inside:
                    yield begin, m.start() + cut
                    begin = end = m.start() + cut
        at = m.end()
        while at < min(len(form), m.end() + 8) and form[at].isascii():
            at += 1
        yield begin, at


@lru_cache(maxsize=50_000)
def _rereadings(chars: str) -> list[tuple[dict[int, str], list[str]]]:
    """What pairs of single-byte encodings make of a word's other than ASCII characters: each mapping with the chains that give it.

    All the encodings agree on ASCII. Mappings with control characters are left out.
    """
    found: dict[tuple[str, ...], list[str]] = {}
    for name in READ_AS:
        data = to_bytes(chars, name)
        if data:
            for origin in READ_AS:
                if origin != name:
                    table = _tables(origin)[1]
                    found.setdefault(tuple(table[b] for b in data), []).append(f"{origin}>{name}")
    return [({ord(c): y for c, y in zip(chars, made)}, chains) for made, chains in found.items() if not CONTROL.search("".join(made))]


def _reread(text: str, made: dict[int, str]) -> str:
    if len(made) > 1:
        return text.translate(made)
    ((c, y),) = made.items()
    return text.replace(chr(c), y)


def _foreign(text: str) -> str:
    return "".join(sorted({c for c in text if c > "\x7f"}))


def _undo_other(text: str) -> dict[str, str]:
    """The texts that pairs of single-byte encodings make of ``text``, each with one of its chains."""
    out = {_reread(text, made): chains[0] for made, chains in _rereadings(_foreign(text)) if not CONTROL.search(text)}
    out.pop(text, None)
    return out


def candidates(form: str) -> dict[str, tuple[float, str]]:
    """Every text that a chain of encode-decode steps, the first one UTF-8, makes of ``form``, with the chain's log-probability and name.

    Single-byte encodings read as each other leave no form to know them by; :meth:`Restorer.stretch` has those.
    """
    found: dict[str, tuple[float, str]] = {}
    frontier = {form: (0.0, "")}
    for _ in range(MAX_STEPS):
        onward: dict[str, tuple[float, str]] = {}
        for text, (cost, chain) in frontier.items():
            if text.isascii():
                continue
            for y, name in _undo_utf8(text).items():
                if y not in found and y != form:
                    onward.setdefault(y, (cost + STEP_UTF8, f"{chain} utf-8>{name}"))
        found |= onward
        frontier = onward
        if not frontier:
            break
    for text, (cost, chain) in list(found.items()):
        if not text.isascii():
            for y, name in _undo_other(text).items():
                if y not in found and y != form:
                    found[y] = (cost + STEP_OTHER_FIRST, f"{chain} {name}")
    return found


#: Characters that misread UTF-8 most often stood for: Latin, Greek and Cyrillic letters, punctuation, currency and letter-like signs, emoji.
ORDINARY = re.compile("[\x00-\x7f\xa0-\u017f\u0370-\u045f\u0490\u0491\u2010-\u203a\u20a0-\u20bf\u2100-\u214f\u2600-\u27bf\ufeff\U0001f300-\U0001faff]*")


def is_clean(text: str) -> bool:
    """No lost or control characters, and no run of other than ASCII characters that reads as UTF-8 for ordinary ones."""
    if text.isascii():
        return True
    if LOST in text or CONTROL.search(text) or LOST_READ.search(text):
        return False
    return not any(_run_reads(r) for r in set(RUN.findall(text)) if len(r) > 1)


@lru_cache(maxsize=100_000)
def _run_reads(run: str) -> bool:
    for name in READ_AS:
        data = to_bytes(run, name)
        if data:
            try:
                if ORDINARY.fullmatch(data.decode("utf-8")):
                    return True
            except UnicodeDecodeError:
                pass
    return False


CORES = Remembered(core)


def _buckets(gram: str) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(gram)
    return h % BUCKETS, BUCKETS + (h >> 32) % BUCKETS


@dataclass
class Model:
    """Interpolated trigram model over a count-min sketch (two rows) of 1-, 2- and 3-grams, case apart; word forms are bounded by a space on either side.

    Counts are of records that have a form, less one: what only the judged record itself may have seen counts as unseen.
    """

    counts: np.ndarray
    total: float
    margin: float = 0.0

    def __post_init__(self):
        self._seen = Remembered(self._count)
        self._steps = Remembered(self._step)
        #: whether clean records have a character
        self._known = Remembered(lambda c: c.isascii() or self._seen[c] > 0)

    def __getstate__(self) -> dict:
        return {"counts": self.counts, "total": self.total, "margin": self.margin}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def _count(self, gram: str) -> float:
        a, b = _buckets(gram)
        return max(0.0, float(min(self.counts[a], self.counts[b])) - 1.0)

    def _n(self, gram: str) -> float:
        return self._seen[gram]

    def _step(self, gram: str) -> float:
        """Log-probability of the last character after the one or two before it."""
        seen, c, b = self._seen, gram[-1], gram[-2]
        p = (seen[c] + 0.01) / (self.total + 1e4)
        p = (seen[b + c] + 4.0 * p) / (seen[b] + 4.0)
        if len(gram) == 3:
            p = (seen[gram] + 4.0 * p) / (seen[gram[:2]] + 4.0)
        return math.log(min(1.0, p))

    def log_probability(self, form: str) -> float:
        s, steps = f" {CORES[form]} ", self._steps
        return steps[s[:2]] + sum([steps[s[i : i + 3]] for i in range(len(s) - 2)])

    def known(self, form: str) -> bool:
        """Whether clean records have all of the form's characters."""
        return all(map(self._known.__getitem__, CORES[form]))

    def possible(self, y: str, chain: str) -> bool:
        """Whether clean records have all characters that ``y`` has, lost ones apart.

        After UTF-8 steps alone, an ordinary character of three bytes and more may be unseen: its sequence is evidence enough to weigh it.
        """
        if self.known(y):
            return True
        unseen = [c for c in CORES[y] if c != LOST and not self._known[c]]
        return not unseen or (all(step.startswith("utf-8>") for step in chain.split()) and all(ord(c) >= 0x800 and ORDINARY.fullmatch(c) for c in unseen))

    def best(self, form: str) -> tuple[str, float, str]:
        """The likeliest candidate, its gain over the form as it is, and its chain; a candidate with further lost characters proves the form garbled."""
        options = [(y, cost, chain) for y, (cost, chain) in candidates(form).items() if self.possible(y, chain)]
        if not options:
            return form, -math.inf, ""
        proof = [o for o in options if o[0].count(LOST) > form.count(LOST) and UNPROVEN not in o[2]]
        own = self.log_probability(form)
        gain, y, chain = max((self.log_probability(y) + cost - own, y, chain) for y, cost, chain in proof or options)
        return y, math.inf if proof else gain, chain


def _add_grams(forms: Counter[str], counts: np.ndarray) -> None:
    """Add the hashed n-grams of forms to the counters; the last counter is the number of characters."""
    grams: Counter[str] = Counter()
    for form, n in forms.items():
        for j in range(0, len(form), 4096):  # n-grams of very long forms by overlapping pieces
            s = f" {form}"[j : j + 4098] if j + 4096 < len(form) else f" {form} "[j:]
            counts[-1] += n * (min(len(form) - j, 4096) + (j + 4096 >= len(form)))
            for k in (1, 2, 3):
                for i in range(0 if not j else 3 - k, len(s) - k + 1):
                    grams[s[i : i + k]] += n
    for g, n in grams.items():
        a, b = _buckets(g)
        counts[a] += n
        counts[b] += n


def gram_counts(records: Iterator[pd.DataFrame], doubtful: Model | None = None) -> Iterator[pd.DataFrame]:
    """Hashed n-gram counts of one partition's records (text, held) that are clean by their form; with a model only of those
    that it finds garbled. One row per slice of the counters: group (1 = held out), slice, part, at, n."""
    from pyspark import TaskContext

    restorer = Restorer(doubtful) if doubtful else None
    counts = np.zeros((2, 2 * BUCKETS + 1), dtype=np.int64)
    forms: list[Counter[str]] = [Counter(), Counter()]
    for pdf in records:
        for text, held in zip(pdf.text, pdf.held):
            if text and is_clean(text) and (restorer is None or restorer.garbled(text)):
                forms[held].update(set(map(CORES.__getitem__, TOKEN.findall(text))))
        for held in (0, 1):
            if len(forms[held]) > REMEMBERED:
                _add_grams(forms[held], counts[held])
                forms[held].clear()
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    for held in (0, 1):
        _add_grams(forms[held], counts[held])
        for i, values in enumerate(np.array_split(counts[held], SLICES)):
            at = np.nonzero(values)[0]
            if len(at):
                yield pd.DataFrame({"held": [held], "slice": [i], "part": [part], "at": [at.astype("<i4").tobytes()], "n": [values[at].astype("<i8").tobytes()]})


SLICE_SCHEMA = "held int, slice int, part int, at binary, n binary"


def _add_slices(pdf: pd.DataFrame) -> pd.DataFrame:
    at = np.concatenate([np.frombuffer(x, "<i4") for x in pdf["at"]])
    n = np.concatenate([np.frombuffer(x, "<i8") for x in pdf["n"]])
    where, back = np.unique(at, return_inverse=True)
    sums = np.zeros(len(where), dtype="<i8")
    np.add.at(sums, back, n)
    return pdf.head(1).assign(part=pdf["part"].min() // FAN_IN, at=[where.astype("<i4").tobytes()], n=[sums.tobytes()])


def merged_counts(slices: DataFrame, parts: int) -> np.ndarray:
    """The counters of all partitions, held-out records in the second row.

    Slices of FAN_IN partitions at a time are added up in rounds, so no task holds more than that many, and what reaches the driver
    does not grow with the input.
    """
    while True:
        slices = slices.withColumn("round", F.floor(F.col("part") / FAN_IN)).groupBy("held", "slice", "round").applyInPandas(lambda pdf: _add_slices(pdf.drop(columns="round")), SLICE_SCHEMA)
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    out = np.zeros((2, 2 * BUCKETS + 1), dtype=np.int64)
    starts = np.cumsum([0, *[len(x) for x in np.array_split(out[0], SLICES)]])
    for r in slices.toLocalIterator():
        out[r["held"], starts[r["slice"]] + np.frombuffer(r["at"], "<i4")] += np.frombuffer(r["n"], "<i8")
    return out


#: Wrong readings that the margin is validated with.
VALIDATION_CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1250"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1251", "koi8_r")]
#: Margins that are tried.
MARGINS = np.arange(2.0, 15.0, 0.5)


def margin_errors(records: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    """Per margin, how many of one partition's held-out clean records exceed it and how many misread ones do not.

    All records that are clean by their form count, whatever they gain. Each is also misread, whole or in its middle
    third, by one of the VALIDATION_CHAINS; a hash of the text says which.
    """
    restorer = Restorer(model)
    clean, bad = [], []
    for pdf in records:
        for text in pdf.text:
            if not is_clean(text):
                continue
            clean.append(restorer.gain(text, MARGINS[0]))
            h = xxhash.xxh64_intdigest(text)
            stretch = text if h % 2 else text[len(text) // 3 : 2 * len(text) // 3]
            garbled = misread(stretch, *VALIDATION_CHAINS[h // 2 % len(VALIDATION_CHAINS)])
            if garbled != stretch and LOST not in garbled:
                bad.append(restorer.gain(text.replace(stretch, garbled, 1), MARGINS[0]))
    over = [int(np.sum(np.array(clean) > m)) for m in MARGINS]
    under = [int(np.sum(np.array(bad) <= m)) for m in MARGINS]
    yield pd.DataFrame({"margin": MARGINS, "clean_over": over, "bad_under": under, "n_clean": len(clean), "n_bad": len(bad)})


def validated_margin(errors: pd.DataFrame) -> float:
    """The middle of the margins with the least errors of both kinds, clean records counting ten times; without records that of a thousand to one."""
    if not len(errors) or not errors.n_bad.max():
        return math.log(1000)
    errors = errors.sort_values("margin")
    total = 10 * errors.clean_over / errors.n_clean + errors.bad_under / errors.n_bad
    least = errors.margin[np.isclose(total, total.min())]
    return float((least.min() + least.max()) / 2)


def train(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Count n-grams of all clean records but one in HELD_OUT, validate the margin on the held-out ones and add their counts.

    A first model is trained on records that are clean by their form; the counts of those that it finds garbled or doubtful are
    then taken back, and what remains is the model. Both passes count held-out records apart, which are
    added once the margin is validated.

    Counts are made per partition and added up in rounds; 4 BUCKETS + 2 numbers at most, and the error counts of
    each margin, reach the driver. No record is sampled or cut.
    """
    held = (F.pmod(F.xxhash64(id_column), F.lit(HELD_OUT)) == 0).cast("int")
    slim = documents.select(held.alias("held"), F.col(text_column).alias("text")).filter(F.length("text") > 0)
    foreign = slim.filter(F.col("text").rlike("[^\\x00-\\x7f]"))
    context = documents.sparkSession.sparkContext
    parts = slim.rdd.getNumPartitions()

    def model_of(counts: np.ndarray) -> Model:
        return Model(counts[:-1].astype(np.float32), float(counts[-1]), DOUBTFUL)

    counts = merged_counts(slim.mapInPandas(gram_counts, SLICE_SCHEMA), parts)
    first = context.broadcast(model_of(counts[0]))
    counts -= merged_counts(foreign.mapInPandas(lambda records: gram_counts(records, first.value), SLICE_SCHEMA), parts)
    trained = context.broadcast(model_of(counts[0]))
    errors = foreign.filter("held = 1").mapInPandas(lambda records: margin_errors(records, trained.value), "margin double, clean_over long, bad_under long, n_clean long, n_bad long")
    model = model_of(counts[0] + counts[1])
    model.margin = validated_margin(errors.groupBy("margin").agg(*[F.sum(c).alias(c) for c in ("clean_over", "bad_under", "n_clean", "n_bad")]).toPandas())
    return model


class Restorer:
    """Judges word forms and stretches of word forms; forms repeat, so what is worked out for them is kept."""

    def __init__(self, model: Model):
        self.model = model
        self.judged = Remembered(self._judge)
        self.other = lru_cache(maxsize=20_000)(self._other)

    def _judge(self, form: str) -> tuple[str, float, float]:
        """The best text by UTF-8 chains, its gain, and the most that a single-byte chain gains by this form."""
        y, gain, _ = self.model.best(form) if _TWO.search(form) else (form, -math.inf, "")
        return y, gain, max([0.0, *(gain for _, gain in self._rescored(form)[1])])

    def utf8(self, form: str) -> tuple[str, float]:
        return self.judged[form][:2]

    def _rescored(self, form: str) -> tuple[list[tuple[str, list[str]]], list[tuple[str, float]]]:
        """What single-byte misreadings would have made this form of: (text, chains) and (text, gain without the step's cost), in one order."""
        word = form.strip(PUNCTUATION)
        if word.isascii() or CONTROL.search(word):
            return [], []
        own = self.model.log_probability(word)
        at = form.index(word)
        had = None
        chains, gains = [], []
        for made, names in _rereadings(_foreign(word)):
            y = _reread(word, made)
            if y == word:
                gain = 0.0
            elif not self.model.known(y):
                continue
            else:
                gain = self.model.log_probability(y) - own
                if gain > 0:
                    # too little to tell: a letter or none, or letters that would become signs
                    had = sum(map(str.isalpha, CORES[word])) if had is None else had
                    has = sum(map(str.isalpha, CORES[y]))
                    if not ((had >= 2 or has >= 4) and 2 * has >= had):
                        gain = 0.0
            whole = form[:at] + y + form[at + len(word) :]
            chains.append((whole, names))
            gains.append((whole, gain))
        return chains, gains

    def _other(self, form: str) -> dict[str, tuple[str, float]]:
        """Per single-byte chain, the text it would have made this form of, with the gain."""
        chains, gains = self._rescored(form)
        return {name: made for (_, names), made in zip(chains, gains) for name in names}

    @staticmethod
    def _runs(forms: list[str], gains: list[dict[str, tuple[str, float]]], name: str, begin: int) -> Iterator[tuple[int, int, float, int]]:
        """Runs of one single-byte chain from ``begin`` on: begin, end, best gain of a stretch from the run's begin on and that stretch's end.

        A run ends where the chain cannot map a form or the gain is used up; what follows does not depend on it. A form that comes again is no further evidence.
        """
        total, best, stop, heard = 0.0, -math.inf, begin, set()
        for i in range(begin, len(forms)):
            if name in gains[i]:
                gain = gains[i][name][1]
                if gain < 0 or forms[i] not in heard:
                    total += gain
                    heard.add(forms[i])
                if total + STEP_OTHER > best:
                    best, stop = total + STEP_OTHER, i + 1
                ends = total <= 0
            else:
                ends = not forms[i].strip(PUNCTUATION).isascii() or total <= 0
            if ends:
                yield begin, i + 1, best, stop
                total, begin, best, heard = 0.0, i + 1, -math.inf, set()
        if begin < len(forms):
            yield begin, len(forms), best, stop

    def stretch(self, forms: list[str]) -> tuple[float, str, int, int]:
        """The best run of forms misread by one single-byte chain: its gain, the chain, begin and end."""
        gains = [self.other(f) for f in forms]
        best = (-math.inf, "", 0, 0)
        for name in {n for g in gains for n, (_, gain) in g.items() if gain > 0}:
            for begin, _, gain, end in self._runs(forms, gains, name, 0):
                if gain > best[0]:
                    best = (gain, name, begin, end)
        return best

    def undo_stretches(self, forms: list[str]) -> bool:
        """Undo the best stretch in place, again and again until none gains more than the margin; whether there was one.

        Each time only the runs that meet the changed forms are scanned anew. It ends, as each time the sum of the
        forms' log-probabilities rises by more than the margin.
        """
        gains = [self.other(f) for f in forms]
        starts: dict[str, bytearray] = {}  # where runs of a chain begin
        live: dict[tuple[str, int], tuple[float, int]] = {}
        heap: list[tuple[float, str, int, int]] = []

        def scan(name: str, begin: int, until: int) -> None:
            marks = starts[name]
            for at, after, gain, end in self._runs(forms, gains, name, begin):
                for i in range(at, after):
                    if marks[i]:
                        marks[i] = 0
                        live.pop((name, i), None)
                marks[at] = 1
                if gain > self.model.margin:
                    live[name, at] = (gain, end)
                    heapq.heappush(heap, (-gain, name, at, end))
                if after >= until and (after == len(forms) or marks[after]):
                    break

        def add(names: set[str]) -> None:
            for name in sorted(names - starts.keys()):
                starts[name] = bytearray(len(forms))
                scan(name, 0, len(forms))

        add({n for g in gains for n, (_, gain) in g.items() if gain > 0})
        found = False
        while heap:
            gain, name, begin, end = heapq.heappop(heap)
            if live.get((name, begin)) != (-gain, end):
                continue
            found = True
            for i in range(begin, end):
                forms[i] = gains[i].get(name, (forms[i], 0.0))[0]
                gains[i] = self.other(forms[i])
            for other, marks in starts.items():
                scan(other, marks.rfind(1, 0, begin + 1), end)
            add({n for g in gains[begin:end] for n, (_, gain) in g.items() if gain > 0})
        return found

    def _forms(self, text: str) -> list[tuple[int, int, str]]:
        """The forms with other than ASCII characters and where they lie; long ones as pieces, each of a run with its surroundings."""
        plain = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        out, end = [], 0
        while m := FOREIGN.search(plain, end):
            begin, end = plain.rfind(" ", end, m.start()) + 1 or end, plain.find(" ", m.end())
            end = len(plain) if end < 0 else end
            form = text[begin:end]
            out += [(begin, end, form)] if len(form) <= 400 else [(begin + a, begin + b, form[a:b]) for a, b in _pieces(form)]
        return out

    def _stretches_may_gain(self, forms: list[str], floor: float) -> bool:
        """Whether the forms' single-byte gains suffice for any stretch to gain more than ``floor``; a form counts once."""
        return sum(self.judged[f][2] for f in set(forms)) + STEP_OTHER > floor

    def gain(self, text: str, floor: float = -math.inf) -> float:
        """The gain of the text's most garbled stretch; one of at most ``floor`` need not be exact."""
        forms = [f for _, _, f in self._forms(text)]
        gain = max([-math.inf, *(self.judged[f][1] for f in forms)])
        return max(gain, self.stretch(forms)[0]) if self._stretches_may_gain(forms, floor) else gain

    def garbled(self, text: str) -> bool:
        """Whether any of the text is garbled, restorable or not."""
        return not text.isascii() and (LOST in text or bool(CONTROL.search(text)) or self.gain(text, self.model.margin) > self.model.margin)

    def text(self, text: str) -> tuple[str, bool]:
        """The restored text, and whether any of it is garbled, restorable or not."""
        if text.isascii():
            return text, False
        margin = self.model.margin
        places = self._forms(text)
        forms = [f for _, _, f in places]
        found = LOST in text or bool(CONTROL.search(text))
        for i, f in enumerate(forms):
            y, gain = self.utf8(f)
            if gain > margin:
                forms[i], found = y, True
        if self._stretches_may_gain(forms, margin):
            found |= self.undo_stretches(forms)  # several stretches may have been misread in several ways
        if not found:
            return text, False
        out, at = [], 0
        for (begin, end, _), y in zip(places, forms):
            out += [text[at:begin], y]
            at = end
        return "".join([*out, text[at:]]), True


def restore(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, restored) of the records with garbled stretches, by whole texts.

    A stretch is garbled if the likeliest encode-decode chain beats the text as it is by more than the
    model's margin, or if it holds U+FFFD or a C1 control character, which no author writes; what
    is lost stays as it is. Defined cases: NULL, empty and ASCII texts are never garbled; repeated rows come out as often as they come in.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(shared.value)
        for pdf in batches:
            out = [(i, y) for i, t in zip(pdf.id, pdf.text) for y, garbled in [restorer.text(t)] if garbled]
            yield pd.DataFrame(out, columns=["id", "restored"])

    kind = documents.schema[id_column].dataType.simpleString()
    slim = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter(F.col("text").rlike("[^\\x00-\\x7f]"))
    return slim.mapInPandas(judge, f"id {kind}, restored string").withColumnRenamed("id", id_column)
