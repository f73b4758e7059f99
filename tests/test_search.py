"""Word forms: published stems, the SQL stems over a vocabulary, and searches for inflected words."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ledgerlark.functions.stem import IRREGULAR, STOP_WORDS, UNCHANGED, common_start, stem, stems_of
from ledgerlark.operators import search
from ledgerlark.plans.stem_sql import STOPS, stems

# word, stem: from the published vocabulary of the algorithm
KNOWN = """caresses caress, ties tie, cries cri, gas gas, this this, gaps gap, agreed agre, feed feed, hoping hope, hopping hop, luxuriated luxuri, cry cri, by by, say say,
relational relat, conditional condit, rational ration, hesitancy hesit, digitizer digit, radically radic, differently differ, vilely vile, analogously analog, operator oper,
decisiveness decis, hopefulness hope, callousness callous, formality formal, sensibility sensibl, triplicate triplic, formative format, electricity electr, goodness good,
revival reviv, allowance allow, inference infer, adjustable adjust, irritant irrit, replacement replac, dependent depend, adoption adopt, communism communism, homologous homolog,
effective effect, rate rate, cease ceas, controlling control, roll roll, consignment consign, consistency consist, knightly knight, knotted knot, generates generat,
generously generous, general general, dying die, news news, innings inning, exceeds exceed, skies sky, happy happi, running run, connections connect, flying fli, enjoy enjoy"""


def test_published_stems(spark):
    pairs = [p.split() for p in KNOWN.replace("\n", " ").split(",")]
    words = spark.createDataFrame(pairs, "word string, want string").repartition(2)
    assert words.withColumn("got", stem(F.col("word"))).filter("got <> want").collect() == []
    assert stems_of(spark, [w for w, _ in pairs]) == [s for _, s in pairs] and stems_of(spark, []) == []
    assert stems_of(spark, ["ab", "x9ing", "ción", ""]) == ["ab", "x9ing", "ción", ""]


@pytest.fixture(scope="module")
def vocabulary(spark, tables):
    made = [a + b + e for a in ("gener", "commun", "fl", "hop", "relat", "y", "ay", "sk", "agr", "x") for b in ("", "e", "i", "ss", "bl", "tt", "y") for e in
            ("", "s", "ed", "ing", "edly", "eed", "ies", "ational", "ization", "fulness", "iveness", "ogi", "logi", "li", "ative", "ement", "ion", "tion", "e", "ll", "iti", "alism")]
    text = tables.chunks.select(F.explode(F.split(F.lower("chunk_text"), r"[^\p{L}\p{N}]+")).alias("w")).distinct().collect()
    return sorted({r.w for r in text} | set(made) | set(IRREGULAR) | set(UNCHANGED) | {w + "s" for w in UNCHANGED})


def test_stems_agree_with_sql(spark, vocabulary):
    con = duckdb.connect()
    con.register("vocabulary", pd.DataFrame({"w": vocabulary}))
    want = dict(con.sql(f"WITH {stems('vocabulary')} SELECT * FROM stems").fetchall())
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").repartition(4).withColumn("s", stem(F.col("w"))).collect()}
    assert len(got) == len(want) > 2000 and got == want
    assert all(w.startswith(common_start(s)) for w, s in got.items())
    assert sorted(STOPS) == sorted(STOP_WORDS) and len(STOP_WORDS) == 127


def test_forms_are_found(spark):
    docs = spark.createDataFrame(
        [("1", "They were connecting the dying hopes."), ("2", "A connection dies, hope does not; connected hopes"), ("3", "connect"), ("4", None), ("5", "disconnected hoping die"), ("6", "")], "id string, body string"
    ).repartition(3)
    find = lambda q: {r.id: round(r.text_rank, 4) for r in search.search_text(docs, "body", q).collect()}
    assert find("connections") == {"1": 1.0, "2": 2.0, "3": 1.0}
    # stop words count as places: connecting(2) hopes(5); connection(1) hope(3), hope(3) connected(6), connected(6) hopes(7)
    assert find("the hoping connect") == {"1": 0.25, "2": round(1 / 3 + 1 / 4 + 1 / 2, 4)}
    assert find("die") == {"1": 1.0, "2": 1.0, "5": 1.0}
    assert find("the of") == {} and find("") == {} and find("absent") == {}


def test_hybrid_without_terms_is_a_vector_search(spark):
    rows = spark.createDataFrame([("1", "a", "word", [1.0, 0.0]), ("2", "a", None, [0.5, 0.5]), ("3", "a", "words", None)], "id string, organization_id string, chunk_text string, embedding array<double>")
    got = rows_of(search.hybrid(rows, "the", [1.0, 0.0], threshold=0.1), "id", "text_rank")
    assert got == [("1", 0.0), ("2", 0.0)]
    assert rows_of(search.hybrid(rows, "wording", [1.0, 0.0], threshold=0.1), "id", "text_rank") == [("1", 1.0), ("2", 0.0), ("3", 1.0)]
