"""Languages, personal data, encoding, packing and severity: round trips, known cases, held-out accuracy, edge cases."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from tidewatch.llm import p1_language as p1
from tidewatch.llm import p6_personal as p6
from tidewatch.llm import p7_encode as p7
from tidewatch.llm import p8_packing as p8
from tidewatch.llm import p9_severity as p9

DATA = "/root/testdata/sf0.01"

SENTENCES = {
    "en": ["the server was restarted before the weekend and nobody noticed", "please send the report to the office after lunch", "we have seen many attempts against this host"],
    "de": ["der server wurde vor dem wochenende neu gestartet und keiner merkte es", "bitte senden sie den bericht nach dem essen an das büro", "wir haben viele versuche gegen diesen rechner gesehen"],
    "ru": ["сервер перезапустили перед выходными и никто не заметил", "пожалуйста отправьте отчёт в офис после обеда", "мы видели много попыток против этого узла"],
    "uk": ["сервер перезапустили перед вихідними і ніхто не помітив", "будь ласка надішліть звіт до офісу після обіду", "ми бачили багато спроб проти цього вузла"],
    "zh": ["服务器在周末之前重新启动没有人注意到", "请在午饭之后把报告寄到办公室", "我们看到了很多针对这台主机的尝试"],
}


@pytest.fixture(scope="module")
def classifier():
    rnd = random.Random(1)
    rows = []
    for _ in range(60):
        for lang, texts in SENTENCES.items():
            shown = lang if rnd.random() > 0.1 else rnd.choice(list(SENTENCES))  # a tenth of the labels is wrong
            rows.append((shown, ". ".join(rnd.sample(texts, 2)) + "."))
    return p1.Classifier(p1.dictionaries(rows))


def test_languages_and_stretches(classifier):
    for lang, texts in SENTENCES.items():
        for t in texts:
            assert [s[2] for s in classifier.stretches(t)] == [lang]
    mixed = f"{SENTENCES['en'][0]}. {SENTENCES['en'][1]}.\n{SENTENCES['ru'][0]}! ok gut\n#tag_x 10.0.0.1\n{SENTENCES['ru'][1]}\n{SENTENCES['en'][2]}"
    got = classifier.stretches(mixed)
    assert [s[2] for s in got] == ["en", "ru", "en"] and all(0 < s[3] <= 1 for s in got)
    assert [mixed[s[0] : s[1]].strip()[:10] for s in got][0] == "the server"
    assert classifier.stretches("server perezapustili pered vyhodnymi i nikto ne zametil")[0][2] == "ru"


def test_languages_of_nothing(classifier, spark):
    for x in (None, "", "  \n ", "ok", "Ann Bob Carl Dora Emil Fay", "10.0.0.1 " * 50, "​"):
        assert classifier.stretches(x) == []
    assert len(classifier.stretches((SENTENCES["ru"][0] + ". ") * 2000)) == 1
    assert p1.dictionaries([]) == {} and p1.Classifier({}).stretches(SENTENCES["en"][0]) == []
    records = spark.createDataFrame([], "id string, language string, content string")
    assert p1.fitted(records, spark.createDataFrame([("en", "en")], "spelling string, lang string")) == {}
    rows = spark.createDataFrame([("a", " EN\t", "x"), ("b", "", "x"), ("c", None, "x"), ("d", "zz", "x")], "id string, language string, content string")
    assert {r.id: r.label_lang for r in p1.labelled(rows, spark.createDataFrame([("en", "en"), ("en", "en")], "spelling string, lang string")).collect()} == {"a": "en", "b": None, "c": None, "d": None}


PERSONAL = [
    ("write to bob.lee+x@mail.test today", "write to <EMAIL> today"),
    ("b_lee [at] mail [dot] test;pw", "<EMAIL>;pw"),
    ("bob@evil.example|hunter22", "<EMAIL>|hunter22"),
    ("root@198.18.26.220 is open", "root@198.18.26.220 is open"),
    ("contact @bob_lee. Then wait", "contact @bob_lee. Then wait"),
    ("ring +44 7700 900 645 now", "ring <PHONE> now"),
    ("ticket 46076-33-174 and session 00389342163", "ticket 46076-33-174 and session 00389342163"),
    ("build 2026.50.199, ISBN-like code 1546-46-115-X", "build 2026.50.199, ISBN-like code 1546-46-115-X"),
    ("social security number 666-71-6597 found", "social security number <NATIONAL_ID> found"),
    ("паспорт серия 0000 номер 387986, телефон 8 000 831 75 99", "паспорт <NATIONAL_ID>, телефон <PHONE>"),
    ("adresse: 14 rue Joda, 79614 Pelyel", "adresse: <ADDRESS>, 79614 Pelyel"),
    ("улица Торборская 97 корпус 8", "<ADDRESS> корпус 8"),
    ("belongs to Martin Kanorham from accounting", "belongs to <NAME> from accounting"),
    ("订单寄给了王芮澈，地址是晗沐县霁沐街96号。", "订单寄给了<NAME>，地址是<ADDRESS>。"),
    ("CVE-2027-12345 of Saporzor Leaks, 10.0.0.1:8080", "CVE-2027-12345 of Saporzor Leaks, 10.0.0.1:8080"),
]


@pytest.mark.parametrize("text,want", PERSONAL)
def test_redaction(text, want):
    assert p6.redacted(text, p6.spans(text)) == want
    assert p6.spans(want) == [] or all(k not in ("email", "phone", "national_id") for _, _, k in p6.spans(want))


def test_validators():
    assert p6.luhn("4539578763621486") and not p6.luhn("4539578763621487")
    assert p6.mod11_2("11010519491231002X") and not p6.mod11_2("110105194912310021")
    assert p6.dni("12345678Z") and p6.dni("X-1234567-L") and not p6.dni("12345678A")
    assert p6.snils("112-233-445 95") and p6.mod97("255081416802538") and p6.mod11("0084575948")


def test_redaction_edges(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "", ""), ("c", "x " * 100_000 + "bob@mail.test", "Nora Doryel-Lahel"), ("c", "hi", "@bob")], "id string, content string, author string")
    got = {(r.id, r.author): (r.content, r.content_kinds, r.author_kinds) for r in p6.scanned(df, ("content", "author")).collect()}
    assert got[("a", None)] == (None, [], []) and got[("b", "")] == ("", [], []) and got[("c", "<NAME>")][1:] == (["email"], ["name"]) and got[("c", "@bob")] == ("hi", [], [])
    assert p6.scanned(df.where("1 = 0"), ("content", "author")).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return p7.TrieEncoder()


TEXTS = ["Hello world, it's 2026!", " leading", "trailing \n\n  spaces ", "Привет, мир", "你好，世界", "سلام دنیا", "🔥🔥 ok", "a" * 3000, "<|endoftext|>", "x​y", "naïve café", "aaa bbb aaa", "\t\ttabs", "1234567890123", "é"]


def test_encoding_equals_the_library(encoder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p7.TOKENIZER)
    t.encode_special_tokens = True
    rnd = random.Random(4)
    texts = TEXTS + ["".join(rnd.choice("abcdeаби ,.1'\n") for _ in range(rnd.randrange(80))) for _ in range(400)]
    pattern = regex.compile(p7.PATTERN)
    for x in texts:
        words = pattern.findall(x)
        encoder.learn(set(words))
        assert [i for w in words for i in encoder.known[w]] == t.encode(x, add_special_tokens=False).ids, x


def test_forgetting_changes_nothing():
    a, b = p7.TrieEncoder(kept=50), p7.TrieEncoder()
    words = [f" w{i}x" for i in range(300)]
    for i in range(0, 300, 20):
        a.learn(set(words[i : i + 20]))
        b.learn(set(words[i : i + 20]))
        assert all(a.known[w] == b.known[w] for w in words[i : i + 20])


def test_encoded_rows(spark):
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "hi there", "z"), (3, "hi there", "z")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in p7.encoded(df, "doc_id", "text").collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got[2][1]) == 2
    assert {r.doc_id: r.n_tokens for r in p7.token_counts(df, "doc_id", "text").collect()} == {1: 0, 2: 0, 3: 2}
    assert p7.encoded(df.where("1 = 0"), "doc_id", "text").count() == 0


def check_packing(rows, sizes, capacity):
    used, places, seen = {}, {}, {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
        places.setdefault(r.container, []).append(r.position)
        seen.setdefault(r.doc_id, []).append((r.piece_no, r.n_tokens))
    assert max(used.values(), default=0) <= capacity
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and sorted(places) == list(range(len(places)))
    for i, n in sizes.items():
        pieces = sorted(seen[i])
        assert sum(x for _, x in pieces) == n and [k for k, _ in pieces] == list(range(len(pieces))) and len(pieces) == max(1, -(-n // capacity))
    return len(places)


def test_packing(spark):
    rnd = random.Random(6)
    sizes = {i: min(5000, int(rnd.paretovariate(0.9) * 20)) for i in range(3000)} | {5001: 0, 5002: 0, 5003: 512}
    targets = spark.createDataFrame([("a", 512), ("b", 2048), ("none", 0), (None, None)], "target_name string, capacity_tokens int")
    df = spark.createDataFrame([*sizes.items(), (5004, None)], "doc_id bigint, n_tokens int")
    rows = p8.packed(df, targets).collect()
    for name, capacity in (("a", 512), ("b", 2048)):
        n = check_packing([r for r in rows if r.target_name == name], sizes | {5004: 0}, capacity)
        assert n <= 1.02 * sum(sizes.values()) / capacity + 1
    assert {r.target_name for r in rows} == {"a", "b"}
    assert p8.packed(df.where("1 = 0"), targets).count() == 0 and p8.packed(df, targets.where("1 = 0")).count() == 0


def test_packing_of_one_size(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(300).alias("n_tokens"))
    rows = p8.packed(df, spark.createDataFrame([("a", 1000)], "target_name string, capacity_tokens int")).collect()
    assert check_packing(rows, {i: 300 for i in range(1000)}, 1000) == 334


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_item(seed):
    rnd = random.Random(seed)
    histogram = {s: rnd.randrange(1, 200) for s in rnd.sample(range(1, 101), 40)}
    runs, got = p8.plan(histogram, 100), {}
    for m, content in runs:
        assert sum(s * n for s, n in content) <= 100
        for s, n in content:
            got[s] = got.get(s, 0) + m * n
    assert got == histogram


GOOD = ["the meeting moved to friday", "please update the parser soon", "kill the orphan process first", "the moderators removed a rude post", "logs are rotated every night"]
BAD = ["you are a worthless idiot and nobody wants you", "go away or i will break your bones", "all those people are vermin and must go"]


def toxic_corpus(spark, n=400, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = rnd.random() < 0.3
        text = [rnd.choice(GOOD) + f" item{rnd.randrange(10**6)}" for _ in range(rnd.randrange(1, 6))]
        if bad:
            s = rnd.choice(BAD)
            text.insert(rnd.randrange(len(text) + 1), s.replace("idiot", "id1ot").upper() if rnd.random() < 0.3 else s)
        docs.append((i, ". ".join(text) + "."))
        labels.append((i, int(bad) if rnd.random() > 0.02 else 1 - int(bad), "r1"))
        if rnd.random() < 0.2:
            labels.append((i, int(bad), "r2"))
    truth = {i for (i, t) in docs if any(b[:8] in t.lower().replace("1", "i") for b in BAD)}
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int, rater string"), truth


def test_severity_on_held_out_documents(spark):
    docs, labels, truth = toxic_corpus(spark)
    model = p9.fitted(docs, labels.where("doc_id < 250"))
    got = {r.doc_id for r in p9.scored(docs, model).where(F.col("severity") >= p9.OFFENDING).collect() if r.doc_id >= 250}
    want = {i for i in truth if i >= 250}
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.9
    assert model.thresholds[0] < model.thresholds[1]


def test_disguises(spark):
    rows = spark.createDataFrame([(0, "you IDIOT"), (1, "you i d i o t"), (2, "you 1diot"), (3, "you idiiiot"), (4, "you id​iot"), (5, "you idiоt")], "i int, t string")
    assert len({tuple(r.h) for r in rows.select(p9.token_hashes(F.col("t")).alias("h")).collect()}) == 1


def test_severity_edges(spark):
    docs = spark.createDataFrame([(1, None, "s", 1.0), (2, "", None, 1.0), (3, "fine text here", "s", 1.0), (3, "fine text here", "s", 1.0), (4, "word " * 50_000, "s", 1.0)], "doc_id bigint, text string, source string, severity double")
    labels = spark.createDataFrame([(3, 0, "a"), (None, 1, "a"), (3, None, "b")], "doc_id bigint, toxic int, rater string")
    model = p9.fitted(docs, labels)
    got = p9.scored(docs.drop("severity"), model, ("doc_id", "source"))
    assert got.count() == 5 and got.where("severity <> 0").count() == 0
    assert {r.source: r.documents for r in p9.rates(got).collect()} == {"s": 4, "": 1}
    assert p9.fitted(docs.where("1 = 0"), labels.where("1 = 0")).weights is None


def test_queries_over_a_folder(spark):
    """Every query runs over its whole tables, and the fixed columns are those asked for."""
    from tidewatch.llm.queries import QUERIES

    columns = {"p1_found": ["id", "seg_no", "lang"], "p2_found": ["id_a", "id_b"], "p3_found": ["id"], "p4_found": ["id", "group_key"], "p5_found": ["id_a", "id_b"], "p6_found": ["id", "field", "kind"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"]}
    for name, f in QUERIES.items():
        df = f(spark, DATA)
        assert df.columns == columns.get(name, df.columns) and df.count() > 0, name
