"""Language-model scores by a class-based bigram model (Brown clustering).

Word counts and word bigrams are counted over all training texts. An
exchange clustering raises the likelihood of the class bigrams: first, on the
driver, that of the most frequent words, while the others share classes by
frequency band; then, on Spark, every other training word moves to the class
that raises it most. The classes of all words are counted anew. A text's
probability is the product of smoothed class transitions and of words given
their class.

Counting, joining, moving and scoring run over the whole corpus on Spark.
Texts are split twice: to count their words, and to write them as word numbers,
from which everything else is read. Bounded by parameters are only the broadcast tier (``TIER`` words) and the
bigram counts of ``CLUSTERED`` words, whose clustering runs on the driver.
Words beyond the tier get their counts and classes by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import most_frequent, store

CLUSTERED = 2_000      # most frequent words that the exchange clustering assigns
CLASSES = 64
BANDS = (5_000, 15_000, 50_000)  # ranks at which further classes begin
TIER = 150_000         # words whose counts and classes every task holds
SWEEPS = 8
TASK_WORDS = 500_000   # distinct words that a task counts before it reports them
TASK_TOKENS = 2_000_000  # tokens whose neighbours a task counts before it reports them
ALIKE = 4              # neighbouring classes of a word, at most, whose class is looked up among those of words alike
TASK_ENTRIES = 10_000  # neighbouring classes of the words that are moved at a time
END = "\n"             # the end token; no word holds a line break
_MORE_BLANKS = "\x1c\x1d\x1e\x1f"  # what else ``str.split`` takes for blanks in ASCII texts


def tokens_of(text: str | None) -> list[str]:
    """Blank-delimited words after lower-casing A-Z, then the end token."""
    text = text or ""
    if text.isascii() and not any(c in text for c in _MORE_BLANKS):
        words = text.lower().split()
    else:
        words = [w.decode() for w in text.encode().lower().split()]
    words.append(END)
    return words


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()

    def told() -> pd.DataFrame:
        return pd.DataFrame({"word": list(seen.keys()), "n": np.fromiter(seen.values(), np.int64, len(seen))})

    for pdf in batches:
        for text in pdf["text"]:
            seen.update(tokens_of(text))
            if len(seen) > TASK_WORDS:
                yield told()
                seen.clear()
    if seen:
        yield told()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all of ``texts`` (text), end tokens included, written once."""
    return store(texts.mapInPandas(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


@dataclass(frozen=True)
class Tier:
    """What every task knows: word numbers by frequency, and their states. A
    state is a clustered word's number or, after those, a class of its own:
    one per band, then the words beyond the tier."""

    number: dict[str, int]
    counts: np.ndarray
    clustered: int

    @property
    def states(self) -> int:
        return self.clustered + 1 + len(BANDS) + 1

    def state(self) -> np.ndarray:
        """Per word number its state; the last entry is for words beyond the tier."""
        n = np.arange(len(self.counts))
        band = self.clustered + np.searchsorted(BANDS, n, side="right")
        return np.append(np.where(n < self.clustered, n, band), self.states - 1)

    def numbers(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, tokens, repeat(len(self.counts))), np.int64, len(tokens))


def coded(texts: DataFrame, tier: Tier) -> DataFrame:
    """``texts`` (text, further columns) with, instead of the text, its word
    ``numbers`` (int32), an end before the first, and its distinct ``words``
    beyond the tier, of which the n-th has the number -n - 1."""
    shared = texts.sparkSession.sparkContext.broadcast(tier)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tier = shared.value
        beyond = len(tier.counts)
        for pdf in batches:
            numbers, words = [], []
            for text in pdf["text"]:
                tokens = [END, *tokens_of(text)]
                at = tier.numbers(tokens).astype(np.int32)
                slots: dict[str, int] = {}
                out = np.flatnonzero(at == beyond)
                at[out] = [-1 - slots.setdefault(tokens[i], len(slots)) for i in out.tolist()]
                numbers.append(at.tobytes())
                words.append(list(slots))
            yield pdf.drop(columns="text").assign(numbers=numbers, words=words)

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in texts.drop("text").schema]
    return texts.mapInPandas(code, ", ".join([*kept, "numbers binary", "words array<string>"]))


@dataclass(frozen=True)
class Pairs:
    """Neighbouring tokens of many coded texts, and how often each pair counts."""

    numbers: np.ndarray  # all texts' word numbers, one text after the other
    texts: np.ndarray    # the text of each
    first: np.ndarray    # where the first word of a pair stands
    times: np.ndarray    # of each pair


def _pairs(numbers: list[bytes], times: np.ndarray) -> Pairs:
    lens = np.array([len(x) // 4 for x in numbers], np.int64)
    texts = np.repeat(np.arange(len(lens)), lens)
    first = np.flatnonzero(texts[:-1] == texts[1:])
    return Pairs(np.frombuffer(b"".join(numbers), np.int32), texts, first, times[texts[first]])


def bigrams(texts: DataFrame, tier: Tier) -> np.ndarray:
    """Counts of neighbouring states over all of ``texts`` (coded, times)."""
    shared = texts.sparkSession.sparkContext.broadcast(tier)
    k = tier.states

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, total = shared.value.state(), np.zeros(k * k, np.int64)
        for pdf in batches:
            p = _pairs(pdf["numbers"].to_list(), pdf["times"].to_numpy())
            s = state[np.where(p.numbers < 0, len(state) - 1, p.numbers)]
            np.add.at(total, s[p.first] * k + s[p.first + 1], p.times)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"pair": at, "n": total[at]})

    rows = texts.select("numbers", "times").mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))

    def dense(pdf: pd.DataFrame) -> pd.DataFrame:
        row = np.zeros(k, np.int64)
        row[pdf["pair"].to_numpy() % k] = pdf["n"].to_numpy()
        return pd.DataFrame({"first": [int(pdf["pair"].iat[0]) // k], "row": [row.tobytes()]})

    # One row per first state comes to the driver: states * states * 8 bytes in all.
    rows = store(rows.groupBy(F.floor(F.col("pair") / k)).applyInPandas(dense, "first long, row binary"), "bigrams")
    out = np.zeros((k, k), np.int64)
    for r in rows.toLocalIterator():
        out[r["first"]] = np.frombuffer(r["row"], np.int64)
    return out


def _by_class(pairs: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Counts of neighbouring classes from counts of neighbouring states."""
    out = np.zeros((of.max() + 1, of.max() + 1))
    for state, row in enumerate(pairs):
        out[of[state]] += np.bincount(of, row, len(out))
    return out


def exchange(pairs: np.ndarray, movable: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each state. The first ``movable`` states are moved, one at a
    time, to the class that raises the likelihood of the class bigrams most,
    until a sweep moves none; the others keep a class of their own."""
    classes = min(classes, max(movable, 1))
    k = len(pairs)
    fixed = k - movable
    of = np.concatenate([np.arange(movable) % classes, classes + np.arange(fixed)])
    t = classes + fixed
    by_class = _by_class(pairs, of)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps if movable > 1 else 0):
        moved = 0
        for w in range(movable):
            a = of[w]
            right = np.bincount(of, pairs[w], t)
            left = np.bincount(of, pairs[:, w], t)
            self_ = float(pairs[w, w])
            right[a] -= self_
            left[a] -= self_
            by_class[a, :] -= right
            by_class[:, a] -= left
            by_class[a, a] -= self_
            rows, cols = by_class[:classes], by_class[:, :classes].T
            diag = np.arange(classes)
            d = by_class[diag, diag]
            gain = (f(rows + right) - f(rows)).sum(axis=1) + (f(cols + left) - f(cols)).sum(axis=1)
            gain += f(d + right[:classes] + left[:classes] + self_) - f(d + right[:classes]) - f(d + left[:classes]) + f(d)
            out, into = rows.sum(axis=1), cols.sum(axis=1)
            gain -= f(out + right.sum() + self_) - f(out) + f(into + left.sum() + self_) - f(into)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            of[w] = b
            by_class[b, :] += right
            by_class[:, b] += left
            by_class[b, b] += self_
        if moved <= movable // 200:
            break
    return of


def best_classes(by_class: np.ndarray, of: np.ndarray, right: np.ndarray, left: np.ndarray, self_: np.ndarray, into: int) -> np.ndarray:
    """Of each of many words the class, among the first ``into``, to which its
    move raises the likelihood of the class bigrams most. Per word: its class,
    counts of the classes after and before it, and how often it follows itself
    (not in the former)."""
    own_class = of[:, None] == np.arange(into)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    gain = np.zeros((len(of), into))
    for near, other, table in ((right, left, by_class[:into]), (left, right, by_class[:, :into].T)):
        i, j = np.nonzero(near)
        if len(i):
            n = near[i, j]
            # Most words are rare: few pairs of a class and a count differ.
            pairs, which = np.unique(n.astype(np.int64) * near.shape[1] + j, return_inverse=True)
            rest = table[:, pairs % near.shape[1]].T
            more = (f(rest + (pairs // near.shape[1])[:, None]) - f(rest))[which]
            # Where the word's own class is met, its own counts are not there.
            own = np.flatnonzero(j == of[i])
            less = np.where(own_class[i[own]], 0, other[i[own], :into])
            e, b = np.nonzero(less)
            rest = table[b, j[own[e]]] - less[e, b]
            more[own[e], b] = f(rest + n[own[e]]) - f(rest)
            e = np.flatnonzero(of[i] < into)
            c = of[i[e]]
            rest = table[c, j[e]] - n[e] - np.where(j[e] == c, other[i[e], c] + self_[i[e]], 0)
            more[e, c] = f(rest + n[e]) - f(rest)
            at, first = np.unique(i, return_index=True)
            gain[at] += np.add.reduceat(more, first, axis=0)
    r, l = right[:, :into], left[:, :into]
    i, b = np.nonzero((r > 0) & (l > 0) | (self_ > 0)[:, None])
    r, l, s = r[i, b], l[i, b], self_[i]
    d = by_class[b, b] - np.where(of[i] == b, r + l + s, 0)
    gain[i, b] += f(d + r + l + s) - f(d + r) - f(d + l) + f(d)
    mine = np.flatnonzero(of < into)
    for near, total in ((right, by_class.sum(axis=1)[:into]), (left, by_class.sum(axis=0)[:into])):
        n = near.sum(axis=1) + self_
        sizes, which = np.unique(n, return_inverse=True)
        more = (f(total + sizes[:, None]) - f(total))[which]
        more[mine, of[mine]] = f(total[of[mine]]) - f(total[of[mine]] - n[mine])
        gain -= more
    return np.argmax(gain, axis=1)


def _steps(step: np.ndarray) -> np.ndarray:
    """Smoothed log10 probabilities of a class after a class."""
    t = len(step)
    ahead = (step.sum(axis=0) + 1) / (step.sum() + t)  # what a class follows in general
    return np.log10((step + t * ahead) / (step.sum(axis=1, keepdims=True) + t))


@dataclass(frozen=True)
class Model:
    tier: Tier
    classes: np.ndarray     # class of each word number, last: beyond the tier
    steps: np.ndarray       # log10 probability of a class after a class
    emission: np.ndarray    # log10 probability of a word number given its class
    base: np.ndarray        # log10((c + 1) / (N + V + 1)) of a word number
    tokens: int             # N
    words: int              # V
    beyond_tokens: int
    beyond_words: int
    pairs: np.ndarray       # counts of neighbouring classes


def vocabulary(texts: DataFrame, tier_size: int = TIER, clustered: int = CLUSTERED) -> tuple[Tier, DataFrame, int, int]:
    """The tier of ``texts`` (text), the word counts of all of them, N and V."""
    counts = word_counts(texts)
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = pd.DataFrame(most_frequent(counts, tier_size).select("word", "n").toLocalIterator(), columns=["word", "n"])  # bounded
    top = top.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    c = top["n"].to_numpy(np.int64)
    return Tier({w: i for i, w in enumerate(top["word"])}, c, min(clustered, len(c))), counts, int(total.n or 0), int(total.v)


def fit(texts: DataFrame, tier: Tier, n: int, v: int, classes: int = CLASSES) -> Model:
    """The model of ``texts`` (coded, times), of ``n`` tokens and ``v`` words."""
    c = tier.counts
    pairs = bigrams(texts, tier)
    of = exchange(pairs, tier.clustered, classes)
    step = _by_class(pairs, of)
    t = len(step)
    steps = _steps(step)
    word_class = of[tier.state()]
    mass = np.bincount(word_class[:-1], c, t) if len(c) else np.zeros(t)
    emission = np.log10(np.append(c / np.maximum(mass[word_class[:-1]], 1), 1.0))
    base = np.log10(np.append(c + 1, 1) / (n + v + 1))
    return Model(tier, word_class, steps, emission, base, n, v, n - int(c.sum()), v - len(c), step)


def train(texts: DataFrame, tier_size: int = TIER, clustered: int = CLUSTERED, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model of ``texts`` (text), and the word counts of all of them."""
    tier, counts, n, v = vocabulary(texts, tier_size, clustered)
    return fit(coded(texts.select("text", F.lit(1).alias("times")), tier), tier, n, v, classes), counts


def neighbours(texts: DataFrame, model: Model) -> DataFrame:
    """(word, near) over all of ``texts`` (coded, times) for every word that
    ``exchange`` did not move, several rows a word. ``near`` are int64 of a code
    plus its count times 2 t + 1. Of t classes, codes below t are the class after
    the word, t and more the one before it, and 2 t stands for the word itself
    after it."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def told(numbers: list[bytes], words: list[np.ndarray], times: np.ndarray) -> pd.DataFrame:
        tier, classes, t = shared.value.tier, shared.value.classes, len(shared.value.steps)
        beyond, width = len(tier.counts), 2 * t + 1
        p = _pairs(numbers, times)
        out = np.flatnonzero(p.numbers < 0)
        starts = np.cumsum([0, *[len(w) for w in words]])
        of_slot, rare = pd.factorize(np.concatenate(words))
        at = p.numbers.astype(np.int64)
        cls = classes[np.where(at < 0, beyond, at)]
        at[out] = beyond + of_slot[starts[p.texts[out]] - 1 - at[out]]
        a, b = at[p.first], at[p.first + 1]
        same = a == b
        left, right = a >= tier.clustered, (b >= tier.clustered) & ~same
        after, before = np.where(same, 2 * t, cls[p.first + 1]), t + cls[p.first]
        keys = np.concatenate([(a * width + after)[left], (b * width + before)[right]])
        by_key = np.argsort(keys, kind="stable")
        keys, n = keys[by_key], np.concatenate([p.times[left], p.times[right]])[by_key]
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        if not len(new):
            return pd.DataFrame({"word": [], "near": []}, dtype=object)
        n, keys = np.add.reduceat(n, new), keys[new]
        word, near = keys // width, (n * width + keys % width).tobytes()
        ends = [*(np.flatnonzero(np.diff(word)) + 1).tolist(), len(word)]
        names = [*tier.number, *rare]  # numbered in this order
        return pd.DataFrame({"word": [names[word[e - 1]] for e in ends], "near": [near[8 * i:8 * j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, words, times, size = [], [], [], 0
        for pdf in batches:
            numbers += pdf["numbers"].to_list()
            words += pdf["words"].to_list()
            times.append(pdf["times"].to_numpy(np.int64))
            size += sum(map(len, pdf["numbers"])) // 4
            if size > TASK_TOKENS:
                yield told(numbers, words, np.concatenate(times))
                numbers, words, times, size = [], [], [], 0
        if numbers:
            yield told(numbers, words, np.concatenate(times))

    return texts.select("numbers", "words", "times").mapInPandas(count, "word string, near binary")


def _whole_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of ``batches``, which are in the order of words, in frames that
    have all rows of each of their words."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        words = pdf["word"].to_numpy()
        ended = np.flatnonzero(words != words[-1:])
        cut = ended[-1] + 1 if len(ended) else 0
        if cut:
            yield pdf.iloc[:cut]
        rest = pdf.iloc[cut:]
    if rest is not None and len(rest):
        yield rest


def place(texts: DataFrame, model: Model) -> DataFrame:
    """``place_coded`` of ``texts`` (text)."""
    return place_coded(coded(texts.select("text", F.lit(1).alias("times")), model.tier), model)


def place_coded(texts: DataFrame, model: Model) -> DataFrame:
    """(word, number, class, n) of ``texts`` (coded, times): every training word
    that ``exchange`` did not move, in that of its classes which raises the
    likelihood of the class bigrams most, written once. All words move by the
    same counts, so that none waits for another. The last class is left to words
    that training lacks. ``number`` is null beyond the tier."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        t, beyond = len(model.steps), len(model.tier.counts)
        width, into = 2 * t + 1, t - (model.tier.states - model.tier.clustered)  # the bands and what is beyond them empty
        # Most words are rare, and words beyond the tier with the same neighbours
        # (told in one row) go to the same class: it is found once in a task.
        met: dict[bytes, int] = {}
        for pdf in _whole_words(batches):
            words, rows = pdf["word"].to_numpy(), pdf["near"].to_numpy()
            starts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            words, ends = words[starts], np.append(starts[1:], len(rows))
            at = model.tier.numbers(words)
            alike = [rows[i] if x == beyond and j == i + 1 and len(rows[i]) <= ALIKE * 8 else None for i, j, x in zip(starts, ends, at, strict=True)]
            best = np.array([-1 if x is None else met.get(x, -1) for x in alike])
            first: dict[bytes, int] = {}
            for i in np.flatnonzero(best < 0).tolist():
                first.setdefault(i if alike[i] is None else alike[i], i)
            todo = np.array(list(first.values()), np.int64)
            blobs = [rows[i] if j == i + 1 else b"".join(rows[i:j]) for i, j in zip(starts[todo], ends[todo], strict=True)]
            upto = np.cumsum([0, *[len(x) // 8 for x in blobs]])
            start = 0
            while start < len(todo):
                end = max(start + 1, int(np.searchsorted(upto, upto[start] + TASK_ENTRIES, side="right")) - 1)
                near = np.zeros((end - start, width))
                entries = np.frombuffer(b"".join(blobs[start:end]), np.int64)
                np.add.at(near, (np.repeat(np.arange(end - start), np.diff(upto[start:end + 1])), entries % width), entries // width)
                right, left, self_ = near[:, :t], near[:, t:2 * t], near[:, -1]
                best[todo[start:end]] = best_classes(model.pairs, model.classes[at[todo[start:end]]], right, left, self_, into)
                start = end
            met |= {alike[i]: best[i] for i in todo.tolist() if alike[i] is not None}
            best = np.array([b if x is None else met[x] for x, b in zip(alike, best, strict=True)], np.int32)
            entries, sizes = np.frombuffer(b"".join(rows), np.int64), np.cumsum([0, *map(len, rows)]) // 8
            comes = np.append(0, np.cumsum(np.where(entries % width >= t, entries // width, 0)))  # all but the classes after a word
            yield pd.DataFrame({"word": words, "number": pd.array(np.where(at < beyond, at, -1), "Int64"), "class": best,
                                "n": comes[sizes[ends]] - comes[sizes[starts]]})
            if len(met) > TASK_WORDS:
                met.clear()

    near = neighbours(texts, model).repartition("word").sortWithinPartitions("word")
    placed = near.mapInPandas(move, "word string, number long, class int, n long")
    return store(placed.withColumn("number", F.when(F.col("number") >= 0, F.col("number"))), "placed")


def with_placed(model: Model, placed: DataFrame) -> tuple[Model, np.ndarray]:
    """The model with the classes of ``placed``, but with the steps as before,
    and the tokens of each class."""
    t, classes = len(model.steps), model.classes.copy()
    for r in placed.filter("number IS NOT NULL").select("number", "class").toLocalIterator():  # bounded by the tier
        classes[r["number"]] = r["class"]
    c = model.tier.counts
    mass = np.bincount(classes[:model.tier.clustered], c[:model.tier.clustered], t) if len(c) else np.zeros(t)
    for r in placed.groupBy("class").agg(F.sum("n").alias("n")).collect():  # one row per class
        mass[r["class"]] += r["n"]
    emission = np.log10(np.append(c / np.maximum(mass[classes[:-1]], 1), 1.0))
    return replace(model, classes=classes, emission=emission, beyond_tokens=0, beyond_words=0), mass


def _read(batches: Iterator[pd.DataFrame], model: Model, mass: np.ndarray) -> Iterator[pd.DataFrame]:
    """Per coded text the classes of its tokens, an end first, and what is told
    of its words: n, known, base, score. ``at``, ``class`` and ``c`` tell the
    classes and counts of its words beyond the tier that training has."""
    unknown, unseen = len(mass) - 1, np.log10(model.tokens + model.words + 1)
    masses = np.log10(np.maximum(mass, 1))
    for pdf in batches:
        rows = []
        for text, words, at, cls, count in zip(pdf["numbers"], pdf["words"], pdf["at"], pdf["class"], pdf["c"], strict=True):
            numbers = np.frombuffer(text, np.int32)
            of, c = np.full(words, unknown), np.zeros(words, np.int64)
            if at is not None:
                of[at], c[at] = cls, count
            out = numbers < 0
            codes = np.empty(len(numbers), np.int16)
            codes[~out] = model.classes[numbers[~out]]
            codes[out] = of[-1 - numbers[out]]
            inside, times = numbers[1:][~out[1:]], np.bincount(-1 - numbers[1:][out[1:]], minlength=words)
            seen = c > 0
            base = model.base[inside].sum() + (times * (np.log10(c + 1) - unseen)).sum()
            score = model.emission[inside].sum() + (times[seen] * (np.log10(c[seen]) - masses[of[seen]])).sum()
            rows.append((codes.tobytes(), len(numbers) - 1, len(inside) + int(times[seen].sum()), float(base), float(score)))
        out = pd.DataFrame(rows, columns=["codes", "n", "known", "base", "score"])
        yield pd.concat([pdf[["doc_id", "text_hash", "times"]].reset_index(drop=True), out], axis=1)


def class_pairs(read: DataFrame, t: int) -> np.ndarray:
    """Counts of neighbouring classes over the training texts of ``read``."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(t * t, np.int64)
        for pdf in batches:
            for codes, times in zip(pdf["codes"], pdf["times"], strict=True):
                c = np.frombuffer(codes, np.int16).astype(np.int64)
                total += times * np.bincount(c[:-1] * t + c[1:], minlength=t * t)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"pair": at, "n": total[at]})

    rows = read.filter("times > 0").select("codes", "times").mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(t * t)
    for r in rows.toLocalIterator():  # at most classes * classes rows
        out[r["pair"]] = r["n"]
    return out.reshape(t, t)


def _score(batches: Iterator[pd.DataFrame], steps: np.ndarray) -> Iterator[pd.DataFrame]:
    """The scores of texts: their words given their classes, and the classes' steps."""
    for pdf in batches:
        seqs = [np.frombuffer(c, np.int16) for c in pdf["codes"]]
        yield pdf.drop(columns="codes").assign(score=pdf["score"] + np.array([steps[c[:-1], c[1:]].sum() for c in seqs]))


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
              tier_size: int = TIER, clustered: int = CLUSTERED, classes: int = CLASSES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    Learnt from the rows where ``held_out`` is not true. Scores are log10
    probabilities of whole texts; base_score is the add-one unigram's. A word
    that training lacks counts as the one unknown word of its class. Null and
    empty texts are an end token, and texts of any length are scored whole; an
    empty table gives no rows. Rows that share an id are scored on their own
    texts; repeated rows each get their row, and count each where they train.
    Extra columns are ignored.

    Exchange clustering gives every training word its class: the most frequent
    (``CLUSTERED``) sweep by sweep, then the others in one distributed sweep.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(id_col).alias("_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    texts = rows.filter("NOT held_out").select("text")
    key = ["doc_id", "text_hash"]
    once = rows.groupBy(*key).agg(F.first("text").alias("text"), F.count_if(~F.col("held_out")).alias("times"))
    tier, _, n, v = vocabulary(texts, tier_size, clustered)
    # Rows are numbered where they are written, so that the number stays.
    known = store(coded(once, tier).withColumn("row", F.monotonically_increasing_id()), "coded", compression="zstd")
    learnt = known.filter("times > 0")
    model = fit(learnt, tier, n, v, classes)
    placed = place_coded(learnt, model)
    model, mass = with_placed(model, placed)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # Words beyond the tier: their classes and counts by a join, then one row per text.
    rare = known.select("row", F.posexplode("words").alias("at", "word"))
    rare = rare.join(placed.filter("number IS NULL").select("word", "class", F.col("n").alias("c")), "word")
    rare = rare.groupBy("row").agg(F.collect_list(F.struct("at", "class", "c")).alias("found"))
    met = known.withColumn("words", F.size("words")).join(rare, "row", "left")
    met = met.select(*key, "times", "numbers", "words", "found.at", "found.class", "found.c")
    read = store(met.mapInPandas(lambda b: _read(b, shared.value, mass), "doc_id string, text_hash long, times long, codes binary, n long, known long, "
                                 "base double, score double"), "read")
    steps = docs.sparkSession.sparkContext.broadcast(_steps(class_pairs(read, len(mass))))
    whole = read.drop("times").mapInPandas(lambda b: _score(b, steps.value), "doc_id string, text_hash long, n long, known long, base double, score double")
    whole = whole.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
                         F.col("base").alias("base_score"), "score")
    out = rows.join(whole, rows["doc_id"].eqNullSafe(whole["_doc"]) & (rows["text_hash"] == whole["_hash"]))
    return out.select(F.col("_id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                      "base_score", "score")
