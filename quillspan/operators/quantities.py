"""Quantities in one unit, from numbers and unit expressions in text.

A stated quantity is ``[opening] [sign] [unit words] [sign] number [unit words] [closing]``. The unit words on both
sides form a product: each word has a scale and a vector of exponents over the base dimensions, scales are multiplied
and exponents added, and the resulting vector names the measure and its canonical unit:

    usd  money^1            US dollars          adet  share^1      single shares
    oran none, but a ratio  basis points        kwh   power^1 time^1  kilowatt-hours
    gun  time^1             days

``value * scale + offset`` is the canonical value (no unit of this lexicon has an offset). Everything is built-in
column arithmetic, so it runs inside the scan's stage.

Defined results: null or empty texts, texts without a number, and texts with words outside the grammar state nothing;
years, quarters and page numbers are removed first and are no quantities; a number without unit words takes what the
question asks for, and states nothing if the question names no unit either.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import let

#: Base dimensions, in the order of the exponent vectors. ``ratio`` marks numbers that are shares of one.
DIMENSIONS = ("money", "share", "power", "time", "ratio")

#: Unit words (lower case): scale to the base units dollar, share, kilowatt, hour and one, and exponents.
LEXICON: dict[str, tuple[float, tuple[int, ...]]] = {}


def _words(words: str, scale: float, **exponents: int) -> None:
    for word in words.split():
        LEXICON[word] = (scale, tuple(exponents.get(d, 0) for d in DIMENSIONS))


_words("k thousand thousands bin tausend mille mil miles milliers tsd", 1e3)
_words("m mm mn mio million millions milyon millionen millones millón", 1e6)
_words("b bn mrd billion billions milyar milliarde milliarden milliard milliards milmillones", 1e9)
_words("$ usd dollar dollars dolar doları usdollar dólar dólares", 1.0, money=1)
_words("share shares pay aktie aktien action actions acción acciones", 1.0, share=1)
_words("% percent pct yüzde prozent pourcent porciento", 1e-2, ratio=1)
_words("permille ‰ binde promille pourmille pormil", 1e-3, ratio=1)
_words("bp bps basispoint basispoints bazpuan basispunkt basispunkte pointdebase pointsdebase puntobásico puntosbásicos", 1e-4, ratio=1)
_words("fractionofone ratio oran kesir", 1.0, ratio=1)
_words("watt w", 1e-3, power=1)
_words("kilo kw", 1.0, power=1)
_words("mega mw", 1e3, power=1)
_words("giga gw", 1e6, power=1)
_words("tera tw", 1e9, power=1)
_words("h hour hours saat stunde stunden heure heures hora horas", 1.0, time=1)
_words("day days gün tag tage tagen jour jours día días", 24.0, time=1)
_words("week weeks hafta woche wochen semaine semaines semana semanas", 168.0, time=1)

#: Expressions of several words or parts, rewritten to words of the lexicon (in this order).
PHRASES = [
    (r"u\.?\s?s\.?\s+dollars?", " usd "), (r"abd\s+dolar[ıi]", " usd "), (r"us-dollars?", " usd "), (r"us\s?\$", r" \$ "), (r"dollars?\s+américains", " usd "),
    (r"mil\s+millones", " milmillones "), (r"(mio|mrd|tsd)\.", " $1 "), (r"per\s+mille|per\s+mil\b", " permille "), (r"pour\s+mille", " pourmille "), (r"por\s+mil\b", " pormil "),
    (r"pour\s+cent", " pourcent "), (r"por\s+ciento", " porciento "), (r"basis\s+points?", " basispoints "), (r"baz\s+puan[ıi]?", " bazpuan "), (r"points?\s+de\s+base", " pointsdebase "),
    (r"puntos?\s+básicos?", " puntosbásicos "), (r"as\s+a\s+fraction\s+of\s+one|birin\s+kesri(\s+olarak)?|als\s+bruchteil\s+von\s+eins|en\s+fraction\s+de\s+un|(como|en)\s+fracción\s+de\s+uno", " fractionofone "),
    (r"an?\s+ratio\s+of|bir\s+oran|ein(em?)?\s+verhältnis\s+von|un\s+ratio\s+de|una\s+razón\s+de", " ratio "),
    (r"(kilo|mega|giga|tera)watt[\s-]*(hours?|saat|stunden?|heures?)", " $1 h "), (r"gigavat[\s-]*saat", " giga h "), (r"megavat[\s-]*saat", " mega h "), (r"(k|m|g|t)wh\b", " $1w h "),
]

#: Words without a meaning of their own between number and unit, and the openings of a statement.
FILLERS = ["de", "d", "of", "a", "in", "olarak", "cinsinden", "approximately", "about", "et"]
OPENING = r"^(the\s+(figure|value|result|amount)\s+is|it\s+is|değer|sonuç|der\s+wert\s+(ist|beträgt)|la\s+valeur\s+est(\s+de)?|el\s+valor\s+es)[\s:]+"

#: What is no quantity: years after their words, quarters, pages.
NO_QUANTITY = r"\b(for|in|für|pour|para|en)?\s*(fy|fiscal(\s+year)?|mali\s+yıl[ıi]|gj|exercice|ejercicio)\s*'?\s*(20)?\d{2}\b|\b(20\d{2})\s+(mali\s+)?yıl[ıi]\w*(\s+için)?|\bq[1-4]\b(\s*20\d{2})?|\b(page|p|sayfa|s|seite)\.?\s*\d+\b"
SPACES = "[\\s\\u00a0\\u202f\\u2009]"
NUMBER = rf"\d+(?:[.,'’]\d+|{SPACES}(?=\d{{3}}(?!\d))\d{{3}})*"

#: Function words by which the language of a text is told.
LANGUAGE_WORDS = {
    "en": "the of and is from for to by this was that on with supports line next so which dollars days weeks hours shares percent thousand",
    "tr": "ve bu bir için ile göre olarak daha yıla geçen ancak çünkü fakat böylece tablo değer yılı dolar doları milyon milyar bin gün hafta saat pay puan yüzde yılında ilk kaldı",
    "de": "der die das und ist nicht wird wurde von im dem beider sich aus wert gegenüber millionen milliarden tausend mio mrd tage wochen stunden aktien basispunkte",
    "fr": "le la les et en du une est pas de des deux par qui dans été figure valeur milliards jours semaines heures actions mille",
    "es": "el los las y del que se una por su fue según valor dos tal para millones dólares días semanas horas acciones puntos mil lee",
}


def language(text: Column, otherwise: Column) -> Column:
    """The language whose function words are most frequent in ``text``; ``otherwise`` where none is met."""
    tokens = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), " "), lambda w: w != "")
    met = lambda t, words: F.size(F.filter(t, lambda w: w.isin(*words)))
    scores = lambda t: F.array(*[F.struct(met(t, words.split()).alias("n"), F.lit(lang).alias("lang")) for lang, words in LANGUAGE_WORDS.items()])
    return let(F.array_max(let(tokens, scores)), lambda best: F.when(best["n"] > 0, best["lang"]).otherwise(otherwise))


def plain_number(number: Column, lang: Column) -> Column:
    """The value of a written number as decimal text: ``1,234.5`` in English, ``1.234,5`` or ``1 234,5`` elsewhere.
    Groups must have three digits each; a mark that cannot part groups is the decimal mark."""
    return let(F.regexp_replace(number, rf"{SPACES}|['’]", ""), lambda n: F.when(lang == "en", _english(n)).otherwise(_other(n)).cast("decimal(30,8)"))


def _english(n: Column) -> Column:
    return (
        F.when(n.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$") | n.rlike(r"^\d+(\.\d+)?$"), F.replace(n, F.lit(","), F.lit("")))
        .when(n.rlike(r"^\d{1,3}(\.\d{3})*,\d+$"), F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(n.rlike(r"^\d{1,3}(\.\d{3}){2,}$"), F.replace(n, F.lit("."), F.lit("")))
    )


def _other(n: Column) -> Column:
    return (
        F.when(n.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$") | n.rlike(r"^\d+(,\d+)?$"), F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(n.rlike(r"^\d{1,3}(,\d{3})*\.\d+$"), F.replace(n, F.lit(","), F.lit("")))
        .when(n.rlike(r"^\d{1,3}(,\d{3}){2,}$"), F.replace(n, F.lit(","), F.lit("")))
    )


def _entries(pick: int) -> Column:
    return F.create_map(*[x for word, entry in LEXICON.items() for x in (F.lit(word), F.lit(entry[0]) if pick == 0 else F.array(*map(F.lit, entry[1])))])


def unit_of(words: Column) -> Column:
    """struct(scale, exponents, known) of an array of unit words; a null scale where a word is unknown."""
    scales, exponents = _entries(0), _entries(1)
    scale = F.aggregate(words, F.lit(1.0), lambda a, w: a * scales[w])
    zero = F.array(*[F.lit(0)] * len(DIMENSIONS))
    total = F.aggregate(words, zero, lambda a, w: F.zip_with(a, exponents[w], lambda x, y: x + y))
    return F.struct(scale.alias("scale"), total.alias("exponents"))


def rewritten(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), PHRASES, F.lower(text))


def unit_words(text: Column) -> Column:
    """The unit words of a piece of text between or beside numbers."""
    spaced = F.regexp_replace(text, r"([$%‰])", " $1 ")
    return F.filter(F.split(F.trim(F.regexp_replace(spaced, r"[^\p{L}$%‰]+", " ")), " "), lambda w: (w != "") & ~w.isin(*FILLERS))


def asked_unit(question: Column) -> Column:
    """Unit words that a (rewritten) question asks for, an empty array if none."""
    q = question
    english = F.regexp_extract(q, r"\b(?:in|expressed)\s+((?:in\s+|us\$|usd\s+|thousands?|millions?|billions?|percent|basispoints|bps|fractionofone|permille|[kmgt]w\s+h|kilo\s+h|mega\s+h|giga\s+h|days|weeks|hours|shares|of\s+shares|of\s+usd|dollars|[\s])+)", 1)
    turkish = F.regexp_extract(q, r"yanıtı\s+([^.?!]*?)\s*(?:cinsinden|olarak|\bver)", 1)
    one = F.when(q.contains("fractionofone"), F.lit("fractionofone"))
    return unit_words(F.coalesce(one, F.nullif(turkish, F.lit("")), F.nullif(F.trim(english), F.lit("")), F.lit("")))


#: Subjects of questions whose measure is not money.
SUBJECTS = [
    ("share", r"share count|number of shares|shares repurchased|pay sayısı"), ("power", r"energy used|electricity|enerji|elektri"),
    ("ratio", r"margin|tax rate|payout ratio|marjı|vergi oranı|dağıtım oranı"), ("time", r"days payable|holding period|payable period|tutma süresi|ödeme süresi"),
]


def measure_of(exponents: Column) -> Column:
    """Name of the measure of an exponent vector; null for a vector that is none of them."""
    is_ = lambda **e: exponents == F.array(*[F.lit(e.get(d, 0)) for d in DIMENSIONS])
    return F.when(is_(money=1), "usd").when(is_(share=1), "adet").when(is_(power=1, time=1), "kwh").when(is_(time=1), "gun").when(is_(ratio=1), "oran")


#: Canonical units: (scale, offset) from base units.
CANONICAL = {"usd": (1.0, 0.0), "adet": (1.0, 0.0), "kwh": (1.0, 0.0), "gun": (1 / 24, 0.0), "oran": (1e4, 0.0)}


def no_dimension(exponents: Column) -> Column:
    return F.forall(exponents, lambda e: e == 0)


def wanted_unit(question: Column) -> Column:
    """struct(scale, exponents) that a question asks for: a null scale where it names no unit, and then the exponents of its subject."""

    def asked(q: Column) -> Column:
        subject = reduce(lambda rest, s: F.when(q.rlike(s[1]), s[0]).otherwise(rest), reversed(SUBJECTS), F.lit("money"))
        implied = let(subject, lambda s: F.array(*[((s == d) | ((s == "power") & F.lit(d == "time"))).cast("int") for d in DIMENSIONS]))
        unit = let(asked_unit(q), lambda w: F.struct(unit_of(w).alias("unit"), (F.size(w) > 0).alias("any")))
        return let(unit, lambda u: F.struct(F.when(u["any"], u["unit"]["scale"]).alias("scale"), F.when(no_dimension(u["unit"]["exponents"]), implied).otherwise(u["unit"]["exponents"]).alias("exponents")))

    return let(rewritten(question), asked)


def nothing_wanted() -> Column:
    """What a record without a question is taken to ask for."""
    return F.struct(F.lit(None).cast("double").alias("scale"), F.array(*[F.lit(int(d == "money")) for d in DIMENSIONS]).alias("exponents"))


def quantity(text: Column, wanted: Column, lang: Column) -> Column:
    """struct(olcu, deger) of the quantity that ``text`` states where ``wanted`` is asked for; null where it states none."""

    def cleaned() -> Column:
        t = F.regexp_replace(F.regexp_replace(F.lower(text), r"[`*_>​]+", " "), NO_QUANTITY, " ")
        t = F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), OPENING, "")
        t = F.regexp_replace(F.regexp_replace(t, r"\bminus\b|\beksi\b|\bmoins\b|\bmenos\b|−|–", "-"), r"[\s.;,]+$", "")
        return rewritten(t)

    def parts(t: Column) -> Column:
        before, number, after = (F.regexp_extract(t, rf"^(\D*?)({NUMBER})(\D*)$", k) for k in (1, 2, 3))
        return F.struct(before.alias("before"), number.alias("number"), unit_words(F.concat_ws(" ", before, after)).alias("words"))

    def value(p: Column, wanted: Column) -> Column:
        # A number alone, or with nothing but a dollar sign, takes the scale that was asked for; otherwise its own.
        signed = F.forall(p["words"], lambda w: w == "$") & (F.element_at(wanted["exponents"], 1) == 1)
        own = unit_of(p["words"])
        scale = F.when(F.size(p["words"]) == 0, wanted["scale"]).when(signed, F.coalesce(wanted["scale"], F.lit(1.0))).otherwise(own["scale"])
        measure = let(own["exponents"], lambda e: measure_of(F.when(no_dimension(e), wanted["exponents"]).otherwise(e)))
        canonical = F.create_map(*[x for k, (s, o) in CANONICAL.items() for x in (F.lit(k), F.struct(F.lit(s).alias("s"), F.lit(o).alias("o")))])
        number = plain_number(p["number"], lang).cast("double") * F.when(p["before"].contains("-"), -1).otherwise(1)
        return let(
            F.struct(measure.alias("olcu"), (number * scale).alias("v")),
            lambda x: let(canonical[x["olcu"]], lambda c: F.struct(x["olcu"].alias("olcu"), F.round(x["v"] * c["s"] + c["o"]).cast("bigint").alias("deger"))),
        )

    stated = let(let(cleaned(), parts), lambda p: F.when(p["number"] != "", value(p, wanted)))
    return let(stated, lambda r: F.when(r["deger"].isNotNull(), r))


def final_statement(answer: Column) -> Column:
    """What follows the last "final answer" mark and stands before a line of sources; null without the mark."""
    tail = F.regexp_extract(answer, r"(?is)^.*final\s+answer[\s*_]*[:=\-–—]?[*_]*(.*)$", 1)
    return F.when(answer.rlike(r"(?i)final\s+answer"), F.regexp_replace(tail, r"(?is)(^|\n)[^\p{L}\n]*sources?\b.*$", ""))


def stated_quantities(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(tablo, kayit_no, olcu, deger) of both tables. An answer's question is that of the record with its id; the
    questions are reduced to one row an id before the join, so repeated records multiply nothing."""
    asked = questions.where("answer IS NOT NULL").select(F.lit("sorular").alias("tablo"), "kayit_no", "answer", "question")
    own = asked.select("tablo", "kayit_no", let(wanted_unit(F.coalesce("question", F.lit(""))), lambda w: quantity(F.col("answer"), w, F.lit("en"))).alias("q"))
    first = questions.where("financebench_id IS NOT NULL").groupBy(F.col("financebench_id").alias("id")).agg(F.coalesce(F.min("question"), F.lit("")).alias("question"))
    first = first.withColumn("wanted", wanted_unit(F.col("question")))  # read once a question, not once an answer
    marked = answers.select("kayit_no", "id", "yanit").where(F.col("yanit").rlike(r"(?i)final\s+answer"))
    joined = marked.join(first, "id", "left").withColumn("question", F.coalesce("question", F.lit("")))
    # The language is that of the text without the mark, the sources, the question repeated and short quotations.
    text = F.regexp_replace(F.regexp_replace("yanit", r"(?i)final\s+answer", " "), r"(?im)^\W*sources?\b.*$|'[^'\n]{8,60}'", " ")
    asked_in = F.when(F.col("question").rlike("[ışğİŞĞ]|şirketinin|yılı"), "tr").otherwise("en")
    stated = let(language(F.replace(text, F.col("question"), F.lit(" ")), asked_in), lambda lang: quantity(final_statement(F.col("yanit")), F.coalesce("wanted", nothing_wanted()), lang))
    theirs = joined.select(F.lit("cevaplar").alias("tablo"), "kayit_no", stated.alias("q"))
    # Spread instead of filtered: a filter on q would be pushed below and read each text twice.
    spread = lambda df: df.select("tablo", "kayit_no", F.inline(F.array_compact(F.array("q"))))
    return spread(own).unionByName(spread(theirs))
