"""Text statistics of every document, and which documents are lists, tables or junk instead of prose.

Statistics come from one pass over the whole text in Arrow batches: characters are classed through a table and summed
by line and by text in numpy, words are counted per text. Labelling rules that look at a few statistics each vote on a
bounded sample of rows and leave doubtful ones unlabelled; gradient-boosted trees learn prose and each other kind
against the rest from these weak labels, and their raw scores become probabilities by a logistic curve fitted to a
small holdout labelled by hand (``quality_holdout``).

Defined results: null, empty and blank texts have zero words and are no case; repeated texts are judged alike.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.quality_holdout import HOLDOUT
from quillspan.session import written

#: Common words of the languages of the corpus, nearly all of them function words.
COMMON = frozenset(
    "the of and to a in that is was for on as by with not which be are were at from or an this it its had has have been under after while although since"
    " der die das und ist nicht mit auf von für im den dem des ein eine wird wurde was sich zu gegenüber"
    " le la les et en du une est pas de au aux par sur qui que ce dans a été un plus"
    " el los las y no del por lo se con una al su para como fue"
    " ve bir bu için ile olarak göre daha ancak çünkü da çok ne kadar gibi fakat böylece nedenle yıla geçen önceki dönemde".split()
)
#: Signs at the start of list entries and at the end of sentences, and separators of cells.
BULLETS, ENDS, SEPARATORS = "-*•–·>(0123456789", ".!?:…\"”»)", "|;\t,"

STATISTICS = [
    "n_words", "mean_word", "common_share", "letter_share", "digit_share", "symbol_share", "broken_share", "distinct_share", "top_share",
    "cell_share", "entry_share", "bullet_share", "end_share", "mean_line", "line_words", "mixed_share", "long_share", "packed",
]

#: What the trees see: neither length nor the way lines end, as prose may be long or short and lack punctuation.
SEEN = [s for s in STATISTICS if s not in ("n_words", "end_share")]

SYMBOL, LETTER, DIGIT, BLANK, BREAK, BROKEN = range(6)
SLICE_CHARS = 2_000_000


def character_classes() -> np.ndarray:
    """A class for every code point. The two letters that begin nearly all doubly encoded ones count as broken."""
    table = np.full(0x110000, SYMBOL, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            table[code] = LETTER
        elif c.isdigit():
            table[code] = DIGIT
        elif c.isspace():
            table[code] = BLANK
    table[[*range(9), *range(14, 32), *range(127, 160), 0xC2, 0xC3, 0xFFFD]] = BROKEN
    table[0x85], table[10] = BLANK, BREAK
    return table


def flags(chars: str) -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in chars]] = True
    return table


class Statistics:
    """The values named in STATISTICS for a list of texts; all shares lie between 0 and 1.

    ``cell_share`` and ``entry_share`` are the shares of characters in lines that look like rows of cells and like
    short entries; ``bullet_share`` and ``end_share`` the shares of lines that begin with a bullet or number and that
    end like a sentence; ``top_share`` is the share of the most frequent word, ``mixed_share`` the number of changes
    between letter and digit for each word, ``long_share`` the share of characters in words of over 30 characters,
    ``packed`` the compressed length over the length.
    """

    def __init__(self) -> None:
        self.classes, self.bullets, self.ends, self.separators = character_classes(), flags(BULLETS), flags(ENDS), flags(SEPARATORS)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(STATISTICS)))
        begin = chars = 0
        for i, t in enumerate(texts):
            chars += len(t or "")
            if chars > SLICE_CHARS or i == len(texts) - 1:
                out[begin : i + 1] = self.measure(texts[begin : i + 1])
                begin, chars = i + 1, 0
        return out

    def measure(self, texts: list[str | None]) -> np.ndarray:
        texts = [t if t and not t.isspace() else "" for t in texts]
        raw = "".join([t + "\n" for t in texts]).encode("utf-32-le", "surrogatepass")
        code = np.frombuffer(raw, np.uint32)
        kind = self.classes[code]
        n = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        start = np.cumsum(n) - n
        size = np.maximum(n - 1, 1)

        line_start = np.concatenate([[0], np.flatnonzero(kind == BREAK)[:-1] + 1])
        first_line = np.searchsorted(line_start, start)
        by_line = lambda x: np.add.reduceat(x, line_start, dtype=np.int64)
        by_text = lambda x: np.add.reduceat(x, first_line)
        letter, digit, blank, broken = (by_line(kind == k) for k in (LETTER, DIGIT, BLANK, BROKEN))
        length = np.diff(np.append(line_start, len(code))) - 1
        ink = length - blank
        solid = (kind != BLANK) & (kind != BREAK) & ~self.separators[code]
        opens = solid & np.concatenate([[True], ~solid[:-1]])
        tokens = by_line(opens)
        wide = by_line(np.concatenate([(kind[1:] == BLANK) & (kind[:-1] == BLANK), [False]]))
        separators = by_line(self.separators[code]) + wide
        # First and last solid character of each line.
        at = np.flatnonzero(solid)
        first = np.searchsorted(at, line_start)
        last = np.append(first[1:], len(at)) - 1
        filled = ink > 0
        opening, closing = np.zeros(len(length), bool), np.zeros(len(length), bool)
        opening[filled], closing[filled] = self.bullets[code[at[first[filled]]]], self.ends[code[at[last[filled]]]]

        cells = filled & (separators >= 2) & (letter < 0.7 * ink) & (letter + digit >= 0.3 * ink) & ((digit >= 0.1 * ink) | (by_line(code == ord("|")) >= 3))
        entry = filled & ~cells & (tokens <= 8) & (length < 90)
        lines = np.maximum(by_text(filled.astype(np.int64)), 1)
        word_at = np.flatnonzero(opens)
        word_end = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]]))
        word_len = word_end - word_at + 1
        long = np.zeros(len(code), np.int64)
        long[word_at] = np.where(word_len > 30, word_len, 0)
        change = np.concatenate([[False], ((kind[1:] == LETTER) & (kind[:-1] == DIGIT)) | ((kind[1:] == DIGIT) & (kind[:-1] == LETTER))])
        n_words = by_text(tokens)
        letters, digits = by_text(letter), by_text(digit)
        words = np.array([self.words(t) for t in texts])
        k = np.maximum(n_words, 1)
        return np.column_stack([
            n_words, by_text(ink) / k, words[:, 0], letters / size, digits / size, (by_text(ink) - letters - digits - by_text(broken)) / size,
            by_text(broken) / size, words[:, 1], words[:, 2],
            by_text(np.where(cells, length, 0)) / size, by_text(np.where(entry, length, 0)) / size,
            by_text((filled & opening).astype(np.int64)) / lines, by_text((filled & closing).astype(np.int64)) / lines, (n - 1) / lines, n_words / lines,
            by_text(by_line(change)) / k, by_text(np.add.reduceat(long, line_start)) / size, words[:, 3],
        ])

    @staticmethod
    def words(text: str) -> tuple[float, float, float, float]:
        """Share of common words, of distinct words and of the most frequent word; compressed over plain length."""
        if not text:
            return 0.0, 0.0, 0.0, 0.0
        counts, raw = Counter(text.lower().split()), text.encode("utf-8", "surrogatepass")
        for w in [w for w in counts if len(w) == 1 and not w.isalnum()]:  # bullets and separators
            del counts[w]
        n = max(1, counts.total())
        common = sum(counts[w] for w in COMMON & counts.keys())
        return common / n, len(counts) / n, max(counts.values(), default=0) / n, len(zlib.compress(raw, 1)) / len(raw)


def measured(documents: DataFrame, text: str = "text") -> DataFrame:
    """All other columns of ``documents`` and the statistics of ``text``, in one narrow stage. Columns that bear the
    name of a statistic are replaced by it."""
    kept = [c for c in documents.columns if c != text and c not in STATISTICS]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        statistics = Statistics()
        for batch in batches:
            values = statistics(batch.column(len(kept)).to_pylist())
            columns = [pa.array(v, pa.float64()) if s != "n_words" else pa.array(v.astype(np.int64)) for s, v in zip(STATISTICS, values.T)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*kept, *STATISTICS])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*kept).schema.fields)
    kinds = ", ".join(f"{s} {'bigint' if s == 'n_words' else 'double'}" for s in STATISTICS)
    return documents.select(*kept, text).mapInArrow(measure, f"{schema}, {kinds}")


#: Labelling rules: (kind, condition). A row that rules of several kinds or of none claim stays unlabelled.
RULES = [
    ("copt", "broken_share > 0.06"),
    ("copt", "long_share > 0.5"),
    ("copt", "top_share > 0.4 AND n_words > 8"),
    ("copt", "mixed_share > 0.25 AND common_share < 0.05"),
    ("copt", "letter_share < 0.3 AND digit_share < 0.05 AND cell_share < 0.3"),
    ("copt", "common_share < 0.2 AND distinct_share < 0.5 AND digit_share < 0.01 AND end_share < 0.1 AND (line_words < 1.6 OR line_words > 15)"),
    ("tablo", "cell_share > 0.55 AND mixed_share < 0.15"),
    ("liste", "entry_share > 0.6 AND common_share < 0.1 AND line_words >= 1.7 AND broken_share < 0.02 AND long_share < 0.3 AND mixed_share < 0.25 AND (digit_share > 0 OR end_share > 0.1)"),
    ("prosa", "common_share > 0.1 AND cell_share < 0.3 AND entry_share < 0.4 AND broken_share < 0.02 AND top_share < 0.3 AND distinct_share > 0.08 AND letter_share > 0.4"),
]
KINDS = ["prosa", "liste", "tablo", "copt"]


def weak_labels(stats: DataFrame) -> DataFrame:
    """``stats`` with ``kind``, where exactly one kind's rules agree."""
    claimed = F.array_compact(F.array_distinct(F.array(*[F.when(F.expr(rule), F.lit(kind)) for kind, rule in RULES])))
    return stats.where("n_words > 0").withColumn("kinds", claimed).where(F.size("kinds") == 1).withColumn("kind", F.col("kinds")[0]).drop("kinds")


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of P(y | x) by Newton's method; targets are drawn in a little, as the holdout is small."""
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    a = np.column_stack([x, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2), a.T @ (t - p) - ridge * w)
    return float(w[0]), float(w[1])


class KindModel:
    """One ensemble of boosted trees for each kind, with its calibration. ``sample_rows`` bounds the rows that are
    learnt from (chosen by a hash of all statistics); everything else sees all rows."""

    def __init__(self, stats: DataFrame, sample_rows: int = 4000, trees: int = 8, depth: int = 4):
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        spark = stats.sparkSession
        self.assembler = VectorAssembler(inputCols=SEEN, outputCol="features")
        labelled = weak_labels(stats)
        keep = max(1, labelled.count() // sample_rows)
        key = F.xxhash64(*STATISTICS)
        sample = labelled.where(F.pmod(key, F.lit(keep)) == 0).orderBy(key).select("kind", *STATISTICS).limit(2 * sample_rows).toPandas()
        sample = sample.sort_values([*STATISTICS, "kind"], ignore_index=True)
        holdout = pd.DataFrame(Statistics()([t for _, t in HOLDOUT]), columns=STATISTICS).assign(kind=[k for k, _ in HOLDOUT])
        rows = spark.createDataFrame(pd.concat([sample.assign(held=False), holdout.assign(held=True)], ignore_index=True)).coalesce(1)
        rows = self.assembler.transform(rows).cache()
        self.models = {}
        for kind in KINDS:
            learnt = rows.where("NOT held").select("features", (F.col("kind") == kind).cast("double").alias("label"))
            if set(sample["kind"]) - {kind} and kind in set(sample["kind"]):
                model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1).fit(learnt)
                model.setRawPredictionCol("raw").setProbabilityCol("").setPredictionCol("")
                held = model.transform(rows.where("held").select("kind", "features")).select("kind", margin("raw").alias("m")).toPandas()
                self.models[kind] = (model, *logistic(held["m"].to_numpy(), (held["kind"] == kind).to_numpy()))
        rows.unpersist()

    def probabilities(self, stats: DataFrame) -> DataFrame:
        """``stats`` with a column ``p_<kind>`` for each kind; a kind that nothing could be learnt for has 0."""
        df = self.assembler.transform(stats)
        for kind in KINDS:
            if kind in self.models:
                model, slope, offset = self.models[kind]
                df = model.transform(df).withColumn(f"p_{kind}", 1 / (1 + F.exp(-(slope * margin("raw") + offset)))).drop("raw")
            else:
                df = df.withColumn(f"p_{kind}", F.lit(0.0))
        return df.drop("features")


def margin(raw: str) -> F.Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(raw))[1]


def judged(documents: DataFrame, **options: int) -> DataFrame:
    """Statistics, probabilities and ``tur``: the likeliest kind of every text that has words (null otherwise)."""
    stats = written(measured(documents), "statistics")
    scored = KindModel(stats, **options).probabilities(stats)
    best = F.array_max(F.array(*[F.struct(F.col(f"p_{k}").alias("p"), F.lit(k).alias("kind")) for k in KINDS]))["kind"]
    return scored.withColumn("tur", F.when(F.col("n_words") > 0, best))


def not_prose(documents: DataFrame, **options: int) -> DataFrame:
    """The documents whose likeliest kind is not prose."""
    return judged(documents, **options).where("tur <> 'prosa'")
