"""Defective answers: clauses tagged by a conditional random field, and their coverage read as a kind of defect.

An answer is cut into clauses (sentences of a line; lines of sources are clauses of their own). A linear-chain CRF
tags each as ``answer`` (states the answer), ``refusal``, ``echo`` (gives the question back), ``foreign`` (an answer in
another language than the question's), ``unfinished`` (breaks off) or ``other`` (reasoning, marks, sources). It is
trained here, on a bounded sample of the answers that labelling rules are sure of, and on pieces of these: conclusions
alone, texts cut at a random place. The shares of characters under each tag then decide:

    bos    no clause has content            kesik  a clause is unfinished, or nothing but reasoning is there
    ret    refusal and no answer            kopya  echo and nothing else that counts
    dil    the answer is foreign

Defined results: a null answer is ``bos``; a missing question echoes nothing and has no language; repeated records are
judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.quantities import LANGUAGE_WORDS, LEXICON

TAGS = ["other", "answer", "refusal", "echo", "foreign", "unfinished"]
OTHER, ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(6)
BUCKETS = 1 << 13
#: Clauses of the longest answer that the CRF is trained on; any number is tagged.
LONGEST_TAUGHT = 16

MARK = re.compile(r"^\W*final\s+answer[\s*_]*[:=\-–—]?[\s*_]*", re.I)
SOURCES = re.compile(r"^\W*sources?\b\W*", re.I)
WHOLE_SOURCE = re.compile(r"(\bnone|,\s*(?:pages?|p\.?|sayfa|seite)?\s*\d+)[\W_]*$", re.I)
LEAD = re.compile(r"^([^\d:.?!]{2,40}?)\s*:\s+(?=\S)|^([^\d:.?!]{2,40}?)\s*:$")
SENTENCE = re.compile(r"(?<=[.!?])(?<!Mio\.)(?<!Mrd\.)(?<!Tsd\.)(?<!U\.S\.)\s+(?=[^\sa-zğışçöü(])")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Expressions by which texts decline and words that turn a sentence round (both for lower-case text), words of
#: agreement, and letters by which languages are told.
DECLINES = re.compile(
    r"\b(?:can(?:no|')t|unable to|not able to|won't|have to decline|must refrain|not possible to|too little to|not disclosed|not (?:contain|hold|give) enough|lacks? the details"
    r"|insufficient information|no answer can|remains unknown|let me (?:state|confirm|calculate|determine|derive|know)|language model|beyond what i am allowed|don't have the data|no access"
    r"|rather not|cannot be (?:determined|stated|answered)|not available|not enough information|declin(?:e|ing) to"
    r"|veremem|veremiyorum|vermemeyi|mümkün değil|yeterli bilgi|yetersiz bilgi|belirlenemiyor|belirlenemez|olamıyorum|olamam|yer almıyor|erişimim olmadığı|bilinmiyor"
    r"|kann (?:ich )?(?:nicht|leider|keine)|leider|nicht möglich|ne peux pas|impossible de|désolé|no puedo|lo siento|no es posible)\b"
)
TURNS = re.compile(r"\b(?:(?<!sorry, )but|yet|ama|ancak|fakat|aber|mais|pero)\b|;")
#: Words beside those of the unit lexicon that a bare quantity may hold.
JOINING = set("de d of a for fy as one fraction ratio us u s per basis point points base baz puan abd megawatt gigawatt kilowatt kwh mwh gwh twh puntos básicos minus".split())
SHORT = {"yes": "en", "evet": "tr", "hayır": "tr", "ja": "de", "nein": "de", "oui": "fr", "non": "fr", "sí": "es", "improved": "en", "weakened": "en"}
LETTERS = {"tr": "ışğİ", "de": "äß", "fr": "èêàûœ", "es": "ñ¿¡áíóú"}
LANGUAGES = {w: {k for k in LANGUAGE_WORDS if w in LANGUAGE_WORDS[k].split()} for k in LANGUAGE_WORDS for w in LANGUAGE_WORDS[k].split()}


SIGNS, NO_LETTERS, SOLID, DIGIT, QUOTED = re.compile(r"[\W_]+"), bytes(i for i in range(128) if not chr(i).isalnum()), re.compile(r"[^\W_]"), re.compile(r"\d"), re.compile(r"['‘\"“][^'\n]{8,60}['’\"”]")
#: Numbers of words as features; bounded, as texts hold ever new ones.
WORD_CODES: dict[str, int] = {}
MOST_CODES = 300_000


def code_of(feature: str) -> int:
    return crc32(feature.encode()) % BUCKETS


def word_code(word: str) -> int:
    if len(WORD_CODES) > MOST_CODES:
        WORD_CODES.clear()
    return WORD_CODES.setdefault(word, code_of(f"w:{word}"))


@lru_cache(maxsize=None)  # some hundreds of shapes
def shape(mark: bool, lead: bool, source: bool, *rest: bool | str) -> list[int]:
    """Features of what a clause looks like, apart from its words."""
    f = ["bias", f"mark{mark}", f"lead{lead}", f"source{source}"]
    if source:
        whole, end = rest
        f += [f"whole{whole}", f"end{end}"]
    else:
        place, closed, number, known, echo, declining, mismatch = rest
        f += [place, f"closed{closed}", f"number{number}", f"echo-{echo}", f"echo-{echo}-{place}", f"declining{declining}", f"declining{declining}-{place}-{mark}"]
        f += [f"{place}-{closed}-{mark}-{lead}", f"{place}-mismatch{mismatch}-{mark or lead}", f"mismatch{mismatch}", f"quantity{known}-{closed}"]
    return [code_of(x) for x in f]


def joined_letters(lower: str) -> str:
    """Letters and digits of a lower-case text alone, without the Turkish difference of i and ı."""
    if lower.isascii():
        return lower.encode("ascii").translate(None, NO_LETTERS).decode("ascii")
    return SIGNS.sub("", lower.replace("ı", "i"))


@lru_cache(maxsize=4096)  # a question comes with many answers and is met in each of their clauses
def bare(text: str) -> str:
    return joined_letters(text.lower())


@lru_cache(maxsize=4096)
def word_set(text: str) -> frozenset[str]:
    return frozenset(WORD.findall(text.lower()))


#: What a word says of its language: function words share their weight, short answers count double.
TELLING: dict[str, list[tuple[str, float]]] = {w: [(k, 1 / len(ks)) for k in sorted(ks)] for w, ks in LANGUAGES.items()}
for _w, _k in SHORT.items():
    TELLING[_w] = [*TELLING.get(_w, []), (_k, 2.0)]


def language_of(texts: list[str]) -> str | None:
    """The language with most function words and own letters; None where nothing tells it."""
    text, score = " ".join(texts), {}
    for w in WORD.findall(text.lower()):
        if w in TELLING:
            for k, weight in TELLING[w]:
                score[k] = score.get(k, 0) + weight
    if not text.isascii():
        for k, letters in LETTERS.items():
            n = sum(text.count(c) for c in letters)
            if n:
                score[k] = score.get(k, 0) + min(n, 4)
    return max(sorted(score), key=score.get) if score else None


@lru_cache(maxsize=4096)
def asked_language(question: str) -> str | None:
    return language_of([question])


class Clause:
    __slots__ = ("text", "lower", "mark", "lead", "source", "words", "echo")

    def __init__(self, text: str, mark: bool, lead: str, source: bool, question: str):
        self.text, self.lower, self.mark, self.lead, self.source = text, text.lower(), mark, lead, source
        self.words = WORD.findall(self.lower)
        self.echo = 0.0 if source else echo_share(self.lower, question, self.words)


def clauses(answer: str | None, question: str) -> list[Clause]:
    """Clauses that have content; a mark or a lead standing alone in its line belongs to the clause after it. A line
    that gives the question back is one clause, however many sentences the question has."""
    out: list[Clause] = []
    mark, lead = False, ""
    for line in (answer or "").split("\n"):
        line = line.strip().lstrip("> \t").strip()
        if not SOLID.search(line):
            continue
        if SOURCES.match(line):
            rest = SOURCES.sub("", line)
            if out or SOLID.search(rest):
                out.append(Clause(rest, False, "", True, question))
            continue
        pieces = SENTENCE.split(line)
        for piece in pieces if len(pieces) == 1 or echo_share(line.lower(), question) <= 0.75 else [line]:
            if MARK.match(piece):
                mark, lead, piece = True, "", MARK.sub("", piece)
            elif (m := LEAD.match(piece)) and len((m[1] or m[2]).split()) <= 6:
                lead, piece = m[1] or m[2], piece[m.end() :]
            if SOLID.search(piece):
                out.append(Clause(piece.strip(), mark, lead, False, question))
                mark, lead = False, ""
    while out and out[0].source and not SOLID.search(out[0].text):
        out.pop(0)
    return out


@lru_cache(maxsize=4096)
def least_echo(question: str) -> int:
    """Letters that a text must have to share over three quarters of the question's words."""
    lengths = sorted(map(len, word_set(question)))
    return sum(lengths[: -(-3 * len(lengths) // 4)])


def echo_share(clause: str, question: str, words: list[str] | None = None) -> float:
    """How far the (lower-case) clause is the question, read as letters and digits only; repeats of the question count whole."""
    a, q = joined_letters(clause), bare(question)
    if not a or not q:
        return 0.0
    if q in a:
        return a.count(q) * len(q) / len(a)
    shared = 0.0
    if len(clause) >= least_echo(question):
        said, asked = set(WORD.findall(clause) if words is None else words), word_set(question)
        shared = len(said & asked) / max(1, len(said), len(asked))
    return max(len(a) / len(q) if len(a) > 12 and a in q else 0.0, shared if shared > 0.75 else 0.0)


class Record:
    """Clauses of one answer, and what can be seen of each beside the question."""

    def __init__(self, answer: str | None, question: str | None):
        self.question = question or ""
        self.clauses = clauses(answer, self.question)
        self.content = [c for c in self.clauses if not c.source]
        own = [c for c in self.content if c.echo < 0.6]
        asked, said = asked_language(self.question), language_of([QUOTED.sub(" ", c.lead + " " + c.text) for c in own])
        self.mismatch = bool(self.question) and asked is not None and said is not None and asked != said

    def features(self) -> list[list[int]]:
        names = []
        last = max((i for i, c in enumerate(self.clauses) if not c.source), default=-1)
        for i, c in enumerate(self.clauses):
            words = c.words
            if c.source:
                names.append(shape(c.mark, bool(c.lead), True, bool(WHOLE_SOURCE.search(c.text)), i == len(self.clauses) - 1))
                continue
            place = "only" if len(self.content) == 1 else "last" if i == last else "early"
            closed = c.text.rstrip("*_` ")[-1:] in ".!?…\"”'»" or i < len(self.clauses) - 1
            number = bool(DIGIT.search(c.text))
            known = number and all(w in LEXICON or w in JOINING for w in words)
            echo = "whole" if c.echo > 0.75 else "part" if c.echo > 0.4 else "none"
            declining = f"True-{bool(TURNS.search(c.lower))}" if DECLINES.search(c.lower) else "False"
            f = [*shape(c.mark, bool(c.lead), False, place, closed, number, known, echo, declining, self.mismatch), code_of(f"first:{' '.join(words[:2])}")]
            f += [WORD_CODES.get(w) or word_code(w) for w in set(words[:14])]
            if c.lead:
                f.append(code_of(f"lead:{c.lead.lower()}"))
            if not closed:
                tail = (f"final:{words[-1] if words else '#'}", f"cut-number{number}-{c.mark}", f"cut-words{min(4, len(words))}-{number}", f"tail:{c.text[-1:] if not c.text[-1:].isalnum() else 'a'}")
                f += map(code_of, tail)
            names.append(f)
        return names


class Crf:
    """Linear chain: weights of features by tag, of neighbouring tags, and of the first and last tag."""

    def __init__(self) -> None:
        k = len(TAGS)
        self.w, self.pair, self.first, self.last = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k)

    @staticmethod
    def batch(sequences: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat feature numbers, the bounds of each clause in them, and the length of each sequence."""
        n = np.array([len(s) for s in sequences], np.int64)
        per = np.array([len(f) for s in sequences for f in s], np.int64)
        flat = np.array([x for s in sequences for f in s for x in f], np.int64)
        return flat, np.concatenate([[0], np.cumsum(per)]), n

    def emissions(self, flat: np.ndarray, bounds: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(sequence, place, tag), zero beyond a sequence's end."""
        out = np.zeros((len(n), int(n.max()), len(TAGS)))
        rows = np.add.reduceat(self.w[flat], bounds[:-1], axis=0)
        out[np.arange(out.shape[1])[None, :] < n[:, None]] = rows
        return out

    def best(self, sequences: list[list[list[int]]]) -> list[list[int]]:
        """Likeliest tags of each sequence (Viterbi), all sequences at a time."""
        used = [i for i, s in enumerate(sequences) if s]
        out: list[list[int]] = [[] for _ in sequences]
        if not used:
            return out
        flat, bounds, n = self.batch([sequences[i] for i in used])
        e = self.emissions(flat, bounds, n)
        score, back = e[:, 0] + self.first, np.zeros(e.shape, np.int64)
        for t in range(1, e.shape[1]):
            step = score[:, :, None] + self.pair[None]
            back[:, t] = step.argmax(axis=1)
            score = np.where((t < n)[:, None], step.max(axis=1) + e[:, t], score)
        tag = (score + self.last).argmax(axis=1)
        for row, i in enumerate(used):
            tags = [int(tag[row])]
            for t in range(int(n[row]) - 1, 0, -1):
                tags.append(int(back[row, t, tags[-1]]))
            out[i] = tags[::-1]
        return out

    def fit(self, sequences: list[list[list[int]]], tags: list[list[int]], steps: int = 150, rate: float = 0.15, ridge: float = 1e-4) -> Crf:
        """Maximum likelihood with a small ridge: gradients by forward and backward sums, steps by Adam."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))  # the live ones at a place come first
        flat, bounds, n = self.batch([sequences[i] for i in order])
        size, length, k = len(n), int(n.max()), len(TAGS)
        live = [int((n > t).sum()) for t in range(length)]
        inside = np.arange(length)[None, :] < n[:, None]
        gold = np.zeros((size, length, k))
        gold[inside, np.array([t for i in order for t in tags[i]])] = 1
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        final = (np.arange(size), n - 1)
        pairs = np.einsum("sti,stj->ij", gold[:, :-1], gold[:, 1:])
        params = [self.w, self.pair, self.first, self.last]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            e, move = self.emissions(flat, bounds, n), np.exp(self.pair)
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0] + self.first
            beta[final] = self.last
            for t in range(1, length):
                x = alpha[: live[t], t - 1]
                top = x.max(axis=1, keepdims=True)
                alpha[: live[t], t] = np.log(np.exp(x - top) @ move) + top + e[: live[t], t]
            total = np.logaddexp.reduce(alpha[final] + self.last, axis=1)
            both = np.zeros((k, k))
            for t in range(length - 1, 0, -1):
                x, y = alpha[: live[t], t - 1], e[: live[t], t] + beta[: live[t], t]
                top_x, top_y = x.max(axis=1, keepdims=True), y.max(axis=1, keepdims=True)
                y = np.exp(y - top_y)
                beta[: live[t], t - 1] = np.log(y @ move.T) + top_y
                both += (np.exp(x - top_x) * np.exp(top_x + top_y - total[: live[t], None])).T @ y
            p = np.exp(alpha + beta - total[:, None, None]) * inside[:, :, None]
            diff = (gold - p)[inside]
            grad_w = np.column_stack([np.bincount(flat, diff[owner, j], BUCKETS) for j in range(k)])
            grads = [grad_w, pairs - both * move, (gold[:, 0] - p[:, 0]).sum(axis=0), (gold - p)[final].sum(axis=0)]
            for i, (g, x) in enumerate(zip(grads, params)):
                g = g / size - ridge * x
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                x += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return self


def weak_tags(r: Record) -> list[int] | None:
    """Tags of an answer that the labelling rules are sure of; None where they are not."""
    if not r.content:
        return None
    last = max(i for i, c in enumerate(r.clauses) if not c.source)
    tags = [OTHER] * len(r.clauses)
    for i, c in enumerate(r.clauses):
        if c.source and i == len(r.clauses) - 1 and not WHOLE_SOURCE.search(c.text):
            tags[i] = UNFINISHED
        elif not c.source and c.echo > 0.75:
            tags[i] = ECHO
    declining = [not c.source and bool(DECLINES.search(c.lower)) and not TURNS.search(c.lower) for c in r.clauses]
    end = r.clauses[last]
    if tags[last] == ECHO:
        return tags if all(t == ECHO or c.source for t, c in zip(tags, r.clauses)) else None
    numbers = bool(DIGIT.search(end.text))
    if declining[last]:
        return [REFUSAL if d else t for d, t in zip(declining, tags)]
    concluded = end.mark or (bool(end.lead) and last > 0)
    words = end.words
    closed = end.text.rstrip("*_` ")[-1:] in ".!?" or last < len(r.clauses) - 1
    if concluded and (closed or (numbers and all(w in LEXICON or w in JOINING for w in words)) or (len(words) == 1 and words[0] in SHORT | {"no": ""})):
        tags[last] = FOREIGN if r.mismatch else ANSWER
        return tags
    if not concluded and not closed and last == len(r.clauses) - 1 and len(r.content) > 1:
        tags[last] = UNFINISHED
        return tags
    if not concluded and closed and len(r.content) > 2:
        return tags
    return None


def training_set(rows: list[tuple[str | None, str | None]], seed: int = 5) -> tuple[list[list[list[int]]], list[list[int]]]:
    """Sure answers, their conclusions alone, and the same texts cut off at a random place."""
    rng = np.random.default_rng(seed)
    x, y = [], []

    def add(record: Record, tags: list[int]) -> None:
        if record.clauses and len(record.clauses) == len(tags) <= LONGEST_TAUGHT:
            x.append(record.features())
            y.append(tags)

    for answer, question in rows:
        r = Record(answer, question)
        tags = weak_tags(r)
        if tags is None:
            continue
        add(r, tags)
        stated = [c for c, t in zip(r.clauses, tags) if t in (ANSWER, FOREIGN)]
        if stated and len(stated[-1].text) > 1:
            alone = Record(stated[-1].text, question)
            if len(alone.clauses) == 1:
                add(alone, [FOREIGN if alone.mismatch else ANSWER])
            first = Record(r.clauses[0].text, question)
            if tags[0] == OTHER and not r.clauses[0].source and len(first.clauses) == 1:
                add(first, [OTHER])
            text = stated[-1].text
            if len(WORD.findall(text)) > 3 and not any(c.isdigit() for c in text):
                short = text[: int(rng.integers(3, len(text) - 2))].rstrip(" .,")
                cut = Record(answer[: answer.rfind(text)] + short, question)
                if cut.clauses and not cut.clauses[-1].source:
                    add(cut, [*tags[: len(cut.clauses) - 1], UNFINISHED])
        for c in [c for c, t in zip(r.clauses, tags) if t == REFUSAL]:
            alone = Record(c.text, question)
            if len(alone.clauses) == 1:
                add(alone, [REFUSAL])
    return x, y


def defect(record: Record, tags: list[int]) -> tuple[str | None, list[float]]:
    """The kind of defect and the share of characters under each tag, sources left out."""
    size = np.zeros(len(TAGS))
    for c, t in zip(record.clauses, tags):
        if not c.source:
            size[t] += len(c.text)
    share = (size / max(1.0, size.sum())).tolist()
    if not record.content:
        return "bos", share
    if UNFINISHED in tags:
        return "kesik", share
    if share[ANSWER] or share[FOREIGN]:
        return ("dil" if share[FOREIGN] > share[ANSWER] else None), share
    if share[REFUSAL]:
        return "ret", share
    if share[ECHO]:
        return "kopya" if share[ECHO] >= share[OTHER] else "kesik", share
    return "kesik", share


def first_questions(questions: DataFrame) -> DataFrame:
    """(id, question): one question for each id."""
    return questions.where("financebench_id IS NOT NULL").groupBy(F.col("financebench_id").alias("id")).agg(F.min("question").alias("question"))


def trained(answers: DataFrame, questions: DataFrame, sample_rows: int) -> Crf:
    """The CRF, fitted to between ``sample_rows`` and twice as many answers, chosen by a hash of the text."""
    keep, key = max(1, answers.count() // sample_rows), F.xxhash64("id", "yanit")
    sample = answers.select("id", "yanit").where(F.pmod(key, F.lit(keep)) == 0).orderBy(key, "id", "yanit").limit(2 * sample_rows)
    sample = sample.join(first_questions(questions), "id", "left").select("yanit", "question").toPandas()
    sample = sample.sort_values(["question", "yanit"], ignore_index=True, na_position="first")
    x, y = training_set([(a, q) for a, q in zip(sample["yanit"], sample["question"])])
    return Crf().fit(x, y) if x else Crf()


def tagged(answers: DataFrame, questions: DataFrame, sample_rows: int = 4000, model: Crf | None = None) -> DataFrame:
    """(kayit_no, kusur, and the share of each tag) of every answer. ``sample_rows`` bounds the answers that the CRF is trained on
    where no ``model`` is given; its weights (BUCKETS by tags) are broadcast."""
    shared = answers.sparkSession.sparkContext.broadcast(model or trained(answers, questions, sample_rows))
    joined = answers.select(F.col("kayit_no").cast("bigint").alias("kayit_no"), "id", "yanit").join(first_questions(questions), "id", "left").select("kayit_no", "yanit", "question")

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                records = [Record(a, q) for a, q in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                found = [defect(r, t) for r, t in zip(records, shared.value.best([r.features() for r in records]))]
                shares = [pa.array([s[i] for _, s in found], pa.float64()) for i in range(len(TAGS))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([k for k, _ in found], pa.string()), *shares], names=["kayit_no", "kusur", *TAGS])

    return joined.mapInArrow(tag, "kayit_no bigint, kusur string, " + ", ".join(f"`{t}` double" for t in TAGS))
