import numpy as np
import pytest

from orrery.llm import offensive as o

WORDS = {w: 50 for w in "the a you are with out open file read frame rows pathetic worthless in range rats street like breed people everyone here knows it and is mesh normal first".split()}


@pytest.fixture(scope="module")
def lm():
    return o.LanguageModel(WORDS)


@pytest.mark.parametrize(
    "written, meant",
    [("w0r7hl355", "worthless"), ("m.o.r.o.n", "moron"), ("i d i o t", "idiot"), ("mooooron", "moron"), ("mo​ron", "moron"), ("m*r*n", "moron"), ("іdіоt", "idiot"), ("SCUMBAG", "scumbag"), ("5cumb4g", "scumbag"), ("a w o r t h l e s s i d i o t", "a worthless idiot")],
)
def test_restores(lm, written, meant):
    assert o.restore(written, lm, {}) == meant


@pytest.mark.parametrize("text", ["with open('out_3.bin', 'rb') as f", "kill -9 917", "buf[9] = v2 + x1;", "2026-06-01 12:30", "a, b, c"])
def test_leaves_code_alone(lm, text):
    assert o.restore(text, lm, {}).replace(" ", "") == text.replace("_", "").replace(" ", "").lower()


def test_viterbi_finds_the_best_path(lm):
    import itertools

    token = "p1g5"
    paths = []
    for pick in itertools.product(*o.lattice(token)):
        text = "".join(x for x, _ in pick)
        past, s = "^^^", sum(c for _, c in pick)
        for ch in text + "$":
            s += lm.logp(past, ch)
            past = (past + ch)[-3:]
        paths.append((s, text))
    best, text = o.viterbi(token, lm)[0]
    assert best == pytest.approx(max(paths)[0]) and text == max(paths)[1]


def test_passages_cover_all_words():
    words = [f"w{chr(97 + i % 26)}" for i in range(1000)]
    parts = o.passages(" ".join(words))
    assert sum(len(p) for p in parts) >= 1000 and max(map(len, parts)) <= o.PASSAGE_WORDS and parts[-1][-1] == words[-1]


DOCS = [(1, "You are a worthless idiot and everyone here knows it.", "s"), (2, "The mesh is normal in the first rows.", "s"), (3, "", "s"), (4, None, None), (5, "I was an idiot and forgot to sort.", "S "), (6, "fine text. " * 3000 + "\nprint('I hope you die, you pathetic m0r0n')", "s"), (7, "12 34 !!", "s")]


def test_scores_with_and_without_reviews(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, reviewer int, verdict string")
    got = {r["doc_id"]: r["score"] for r in o.score(docs, o.train(docs, none)).collect()}
    assert got[1] > 0.5 and got[6] > 0.5 and got[2] < 0.1 and got[3] == got[4] == got[7] == 0.0 and got[5] < 0.25
    rates = {r["source"]: r for r in o.rates(o.score(docs, o.train(docs, none)), docs["source"]).collect()}
    assert rates["s"]["n_flagged"] == 2 and rates["s"]["n_docs"] == 5
    assert o.score(docs.limit(0), o.train(docs.limit(0), none)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, reviews = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/doc_reviews.parquet")
    model = o.train(docs, reviews.filter("doc_id % 2 = 0"))
    rest = o.reviewed(docs, reviews.filter("doc_id % 2 = 1"))
    scored = o.score(rest, model).select("y", "score").collect()
    right = sum((r["score"] >= o.THRESHOLD) == (r["y"] == 1) for r in scored)
    assert right >= 0.93 * len(scored)  # reviewers slip in about one of twenty


def test_spacing_and_digits_are_read_jointly(lm):
    assert o.restore("y 0 u w 0 r t h l e s s i d i 0 t", lm, {}) == "you worthless idiot"


def test_long_tokens_are_decoded_too(lm):
    run = "".join("w0r7hl355" for _ in range(1)) + "x" * 0
    token = "zz.qq." * 20 + run + ".qq.zz" * 20
    assert o.restore("1d10t" + "!" * 3, lm, {}).startswith("idiot")
    assert isinstance(o.restore(token, lm, {}), str) and o.restore("f***", lm, {}) == "f***"


def test_table_from_spark_equals_the_one_from_counts(spark):
    docs = spark.createDataFrame([(1, "The mesh, the MESH and a plane."), (2, None), (3, "")], "doc_id long, text string")
    counts = {"the": 2, "mesh": 2, "and": 1, "plane": 1}
    assert o.gram_weights(docs) == pytest.approx(o.gram_table({w: np.log1p(n) for w, n in counts.items()}))


@pytest.fixture(scope="module")
def trained(spark):
    """Models with and without the lexicon, fitted on the reviews with even doc_id of the larger check input."""
    sf = "/root/testdata/check_l"
    docs, reviews = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/doc_reviews.parquet")
    even = reviews.filter("doc_id % 2 = 0")
    return docs, reviews, o.train(docs, even), o.train(docs, even, lexicon=False)


def test_lexicon_is_no_crutch(trained):
    docs, reviews, with_lists, without = trained
    rest = o.reviewed(docs, reviews.filter("doc_id % 2 = 1")).cache()
    recall = [o.score(rest.filter("y = 1"), m).filter(f"score >= {o.THRESHOLD}").count() for m in (with_lists, without)]
    assert recall[1] >= 0.95 * recall[0]
    fine = rest.filter("y = 0")
    assert o.score(fine, without).filter(f"score >= {o.THRESHOLD}").count() <= 0.02 * fine.count()


UNSEEN = ["you are a stupid useless rat, nobody wants you here", "I will find your house and break your neck", "y 0 u  a r e  w 0 r t h l e s s", "I hope you d1e, you p4th3t1c pig", "people like you should be shot"]
HARMLESS = ["The process was killed by the scheduler after a timeout.", "My question is stupid, sorry, I was an idiot.", "Strip the header and drop the naked rows.", "Kill the worker and abort the join, it is worthless."]


def test_sentences_that_no_review_holds(trained):
    scorer = o.Scorer(trained[2])
    assert (scorer.texts(UNSEEN) >= o.THRESHOLD).all()
    assert (scorer.texts(HARMLESS) < o.THRESHOLD).all()
