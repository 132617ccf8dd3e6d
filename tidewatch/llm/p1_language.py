"""Missing or wrong document language labels (problem 1).

Method: compression classification. Each language, in each script it is written in, has a zstandard raw-content dictionary of
sample sentences; a sentence belongs to the language whose dictionary makes it smallest. Where the two smallest sizes are
closer than ``MARGIN`` the sentence is rejected and has no language. The confidence is the share of the second size
that the best one saves, averaged over a stretch by its words.

The dictionaries are fitted on at most ``SAMPLE`` labelled records a language (those of smallest id hash). Labels are wrong
at times, and a dictionary remembers every sentence it is given; so sample sentences first vote, by the labels that their
words have in the whole sample, and only those go into a dictionary whose vote is clear.

Only sentences count: five words or more (for Chinese, five characters) after indicators, handles, numbers and hashtags are
taken out. Consecutive sentences of one language are a stretch; rejected sentences and scraps neither are nor end one. Null,
empty and blank contents have no stretch and no language.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.tables import table

LANGUAGES = ("ru", "en", "uk", "de", "es", "fr", "fa", "zh")
SAMPLE = 800
DICTIONARY_BYTES = 48_000
LEVEL = 3
MARGIN = 0.15
LEAST_WORDS = 5
#: Sample sentences that a language must have in a script to get a dictionary for it.
LEAST_SENTENCES = 12

#: Romanisation of Russian and Ukrainian (fixed values).
ROMAN = {
    "ru": str.maketrans({"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya"}),
    "uk": str.maketrans({"а": "a", "б": "b", "в": "v", "г": "h", "ґ": "g", "д": "d", "е": "e", "є": "ye", "ж": "zh", "з": "z", "и": "y", "і": "i", "ї": "yi", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ь": "", "ю": "yu", "я": "ya", "'": "", "’": ""}),
}

INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
BREAK = re.compile(r"[.!?…؟]+[\"»”)\]]*(?=\s|$)|[。！？；]+|\n+")
INDICATOR = re.compile(r"[!-~]*[@/\\_#<>|={}\d][!-~]*|[!-~]+\.[!-~]+|[!-~]*\[[.:]\][!-~]*")
LETTERS = re.compile(r"[^\W\d_]+")
HAN = re.compile("[㐀-䶿一-鿿]")
ARABIC = re.compile("[؀-ۿﭐ-﷿ﹰ-﻿]")
CYRILLIC = re.compile("[Ѐ-ԯ]")


def sentences(text: str) -> list[tuple[int, int, str, str, int]]:
    """(start, end, script, plain text, words) of the text's sentences; positions are those in ``text``."""
    out, start = [], 0
    for end, after in [*((m.start(), m.end()) for m in BREAK.finditer(text)), (len(text), len(text))]:
        piece = text[start:end]
        if len(piece) >= LEAST_WORDS:
            plain = INDICATOR.sub(" ", INVISIBLE.sub("", piece))
            han = len(HAN.findall(plain))
            if han >= LEAST_WORDS:
                out.append((start, end, "han", plain.lower(), han))
            else:
                words = LETTERS.findall(plain)
                if len(words) >= LEAST_WORDS:
                    letters = "".join(words)
                    cyrillic, arabic = len(CYRILLIC.findall(letters)), len(ARABIC.findall(letters))
                    latin = len(letters) - cyrillic - arabic - han
                    # Names are capitalised; a sentence has other words, unless it is all in capitals.
                    lower = sum(w[0].islower() or not w[0].isupper() for w in words)
                    if lower >= 3 or sum(w.isupper() for w in words) >= LEAST_WORDS:
                        # Names come in Latin and Cyrillic letters, so the words that aren't names decide.
                        own = [w for w in words if not (w[0].isupper() and w[1:].islower())] or words
                        cyr = sum(bool(CYRILLIC.match(w)) for w in own)
                        ara = sum(bool(ARABIC.match(w)) for w in own)
                        lat = len(own) - cyr - ara
                        script = "arabic" if ara and ara >= max(cyr, lat) else "cyrillic" if cyr > lat or (cyr == lat and cyrillic > latin) else "latin"
                        out.append((start, end, script, plain.lower(), len(words)))
        start = after
    return out


def selection(texts: list[str], limit: int = DICTIONARY_BYTES) -> bytes:
    """Sentences up to ``limit`` bytes: first those with a word of the language (one of several sentences) that has stood in
    fewer than three chosen ones, so rare phrases are in, then others in their order."""
    texts = list(dict.fromkeys(texts))
    split = [set(HAN.findall(t) or LETTERS.findall(t)) for t in texts]
    common = {w for w, n in Counter(w for ws in split for w in ws).items() if n >= 3}
    seen: Counter = Counter()
    new, rest = [], []
    for t, ws in zip(texts, split):
        ws = ws & common
        if any(seen[w] < 3 for w in ws):
            seen.update(ws)
            new.append(t)
        else:
            rest.append(t)
    chosen, size = [], 0
    for t in new + rest:
        b = t.encode()
        if size + len(b) + 1 > limit:
            break
        chosen.append(b)
        size += len(b) + 1
    return b"\n".join(chosen[::-1])  # what lies nearest to the text is found most cheaply


def dictionaries(rows: list[tuple[str, str]]) -> dict[str, dict[str, bytes]]:
    """(label, content) rows -> script -> language -> dictionary content."""
    votes: dict[str, Counter] = defaultdict(Counter)
    pool = []
    totals = Counter()
    for label, content in rows:
        for _, _, script, plain, _ in sentences(content):
            words = set(HAN.findall(plain) if script == "han" else LETTERS.findall(plain))
            pool.append((label, script, plain, words))
            totals[label] += 1
            for w in words:
                votes[w][label] += 1
    kept: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    for label, script, plain, words in pool:
        score: Counter = Counter()
        for w in words:
            seen = votes[w]
            if sum(seen.values()) >= 4:
                shares = {k: seen[k] / totals[k] for k in totals}
                whole = sum(shares.values())
                for k in totals:
                    score[k] += math.log((shares[k] + 0.02 * whole) / whole)
        if score:
            (best, a), *rest = score.most_common(2)
            if best == label and (not rest or a - rest[0][1] > 1.0):
                kept[script][label].append(plain)
    out: dict[str, dict[str, bytes]] = {}
    for script, by in kept.items():
        most = max(map(len, by.values()))
        for label, texts in by.items():
            # A script that a language is hardly ever seen in is a mislabelled rest.
            if len(texts) < LEAST_SENTENCES and len(texts) < most:
                continue
            if script == "latin" and label in ROMAN:
                continue
            out.setdefault(script, {})[label] = selection([" ".join(x.split()) for x in texts])
    # Languages of other letters are also written in Latin ones: seen sentences, and the others romanised.
    for label, table in ROMAN.items():
        seen = kept.get("latin", {}).get(label, []) if len(kept.get("latin", {}).get(label, [])) >= LEAST_SENTENCES else []
        romanised = [x.translate(table) for x in kept.get("cyrillic", {}).get(label, [])]
        if seen or romanised:
            out.setdefault("latin", {})[label] = selection([" ".join(x.split()) for x in seen + romanised])
    return out


class Classifier:
    """Sizes under each language's dictionary -> language and confidence."""

    def __init__(self, content: dict[str, dict[str, bytes]], level: int = LEVEL, margin: float = MARGIN):
        import zstandard

        self.margin = margin
        self.by_script = {}
        for script, by in content.items():
            made = []
            for label, data in by.items():
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                made.append((label, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress))
            self.by_script[script] = made

    def __call__(self, script: str, plain: str) -> tuple[str | None, float]:
        data = " ".join(plain.split()).encode()
        sizes = sorted((len(compress(data)), label) for label, compress in self.by_script.get(script, ()))
        if not sizes:
            return None, 0.0
        best, label = sizes[0]
        second = sizes[1][0] if len(sizes) > 1 else max(len(data) + 9, best)
        confidence = 1 - best / second
        return (label if confidence >= self.margin else None), confidence

    def stretches(self, text: str | None) -> list[tuple[int, int, str, float, int]]:
        """(start, end, language, confidence, words) of the stretches of a text."""
        out: list[list] = []
        for start, end, script, plain, n in sentences(text or ""):
            label, confidence = self(script, plain)
            if label is None:
                continue
            if out and out[-1][2] == label:
                last = out[-1]
                last[1], last[3], last[4] = end, (last[3] * last[4] + confidence * n) / (last[4] + n), last[4] + n
            else:
                out.append([start, end, label, confidence, n])
        return [tuple(x) for x in out]


def labelled(records: DataFrame, names: DataFrame) -> DataFrame:
    """``records`` with label_lang: the language of the label, null if it is missing or no known spelling."""
    spelling = names.select(F.col("spelling").alias("_spelling"), F.col("lang").alias("label_lang")).dropDuplicates(["_spelling"])
    return records.withColumn("_spelling", F.lower(F.regexp_replace("language", r"(?U)^\s+|\s+$", ""))).join(spelling, "_spelling", "left").drop("_spelling")


def fitted(records: DataFrame, names: DataFrame, sample: int = SAMPLE) -> dict[str, dict[str, bytes]]:
    """Dictionaries from at most ``sample`` labelled records a language."""
    known = labelled(records.select("id", "language", "content"), names).where(F.col("label_lang").isin(*LANGUAGES) & F.col("content").isNotNull())
    counts = {r["label_lang"]: r["n"] for r in known.groupBy("label_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    million = 1_000_000
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("label_lang") == lang, F.lit(min(million, math.ceil(1.1 * sample / n * million) + 1))).otherwise(share)
    got = known.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(million))).where(F.col("h") < share).select("label_lang", "content", "h", "id").toPandas().sort_values(["h", "id"])
    rows = []
    for lang in LANGUAGES:
        rows += [(lang, c) for c in got.content[got.label_lang == lang][:sample]]
    return dictionaries(rows)


STRETCH = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("words", T.IntegerType())]))


def with_stretches(records: DataFrame, content: dict[str, dict[str, bytes]], keep: list[str]) -> DataFrame:
    """``keep`` columns and ``stretches`` of every record, from its column ``content``."""
    shared = records.sparkSession.sparkContext.broadcast(content)
    schema = T.StructType([*[records.schema[c] for c in keep], T.StructField("stretches", STRETCH)])
    names = [f.name for f in schema]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32())]))

    def run(batches):
        classifier = Classifier(shared.value)
        for b in batches:
            found = [[dict(zip(("start", "stop", "lang", "confidence", "words"), s)) for s in classifier.stretches(x)] for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], names=names)

    return records.select(*keep, "content").mapInArrow(run, schema)


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_content's (id, label_lang, stretches)."""
    records, names = table(spark, sf_dir, "raw_content"), table(spark, sf_dir, "lang_names")
    return with_stretches(labelled(records.select("id", "language", "content"), names), fitted(records, names), ["id", "label_lang"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = languages(spark, sf_dir).where(F.size("stretches") > 0)
    several = F.size(F.array_distinct(F.col("stretches.lang"))) > 1
    wrong = F.col("label_lang").isNull() | (F.col("label_lang") != F.col("stretches")[0]["lang"])
    return x.where(several | wrong).select("id", F.posexplode("stretches").alias("p", "s")).select("id", (F.col("p") + 1).alias("seg_no"), F.col("s.lang").alias("lang")).distinct()


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every record with its place in the text, language and confidence."""
    x = languages(spark, sf_dir).select("id", F.posexplode("stretches").alias("p", "s"))
    return x.select("id", (F.col("p") + 1).alias("seg_no"), "s.lang", "s.confidence", "s.words", "s.start", "s.stop")


def p1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its language (that of most words; null without a sentence) and confidence, beside its label's."""
    x = languages(spark, sf_dir)
    longest = F.expr("array_max(transform(stretches, s -> struct(aggregate(filter(stretches, r -> r.lang = s.lang), 0, (n, r) -> n + r.words) as words, s.lang as lang, s.confidence as confidence)))")
    return x.withColumn("top", longest).select("id", "label_lang", "top.lang", "top.confidence", F.size("stretches").alias("n_stretches"))
