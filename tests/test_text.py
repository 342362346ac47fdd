"""Column functions on single values."""

import random

import pytest
from pyspark.sql import functions as F

from citeresolve.functions import fuzzy
from citeresolve.functions import text as X


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for i, v in enumerate(values)))
    return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (X.fold, "  Súmula  VINCULANTE nº ", "sumula vinculante no"),
        (X.clean, "Recur-\nso.. , doaÃ§Ã£o​", "Recurso. , doação"),
        (X.ocr_digits, "1.5O8.7lI", "1508711"),
        (X.short_key, "1528455", 1528455),
        (X.short_key, "123456789", None),
        (X.cnj_seq, "10001020155020001", 1000),
        (X.cnj_tail, "10001020155020001", "1020155020001"),
        (X.cnj_justice, "1020155020001", "TST"),
        (X.trailing_uf, "REsp 1.528.455/RJ", "RJ"),
        (X.trailing_uf, "REsp 1.528.455/XX", None),
        (X.article_number, "art. 373, I, do CPC", 373),
        (X.article_number, "art. 5º da CF", 5),
        (X.article_number, "artigo l5O do CC", 150),
        (X.article_number, "art. 1.022 do CPC", 1022),
        (X.diploma_key, "art. 373 do codigo de processo civil", "CPC"),
        (X.diploma_key, "art. 5o do cpc/73", "CPC/1973"),
        (X.diploma_key, "art. 6 da lei no 8.078/90", "CDC"),
        (X.diploma_key, "art. 6 da lei no 13.467/2017", "LEI:13467/2017"),
        (X.diploma_key, "nada", None),
        (X.appeal_chain, "edcl no agint no resp", ["AGINT", "ED"]),
        (X.class_code, "EDcl no AgInt no AREsp 1.2", "AREsp"),
        (X.class_code, "RECURSO ESPECIAL Nº 1.528.455", "REsp"),
        (X.courts_in, "do STJ e do Supremo Tribunal Federal", ["STJ", "STF"]),
        (X.name_tokens, "Min. M0rgana de VER5IANI", ["morgana", "versiani"]),
        (X.is_date, "17/5/2021", True),
        (X.is_number_marker, "nº", True),
        (X.is_number_marker, "rio", False),
        (X.year4, 15, 2015),
        (X.year4, 88, 1988),
        (X.year4, 412, None),
    ],
)
def test_values(spark, f, value, want):
    assert one(spark, f, value) == want


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,)], "c string")
    for f in (X.fold, X.clean, X.ocr_digits, X.diploma_key, X.article_number, X.class_code):
        assert df.select(f(F.col("c")).alias("x")).first()["x"] is None


def test_chain_distance(spark):
    assert one(spark, X.chain_distance, ["AGINT"], ["AGINT"]) == 0
    assert one(spark, X.chain_distance, ["AGINT"], []) == 11
    assert one(spark, X.chain_distance, ["ED", "ED"], ["ED"]) == 1


def test_find_spans_counts_code_points(spark):
    got = one(spark, lambda c: X.find_spans(c, "x+"), "😀😀xx é x")
    assert [(r["s"], r["e"], r["x"]) for r in got] == [(2, 4, "xx"), (7, 8, "x")]
    assert one(spark, lambda c: X.find_spans(c, "x+"), "none") == []


def test_fuzzy():
    assert abs(fuzzy.similarity("agravo", "argavo") - 0.833) < 0.001
    assert fuzzy.repair_word("agrãv0") == "agravo"
    assert fuzzy.canonical_words("Agr. Int. no Rec. Espec.") == "agravo interno no recurso especial"
    assert fuzzy.number_groups("REsp 1.5O8.709, em 17/5/2021") == ["1508709"]
    assert fuzzy.align("o RE5P 1.234 foi", "resp 1.234") == (2, 12)
    assert fuzzy.align("nada", "resp 1.234") is None
    assert fuzzy.names_match(["fulano"], ["fulanno", "tal"]) and not fuzzy.names_match(["fulano"], [])


def test_keys_of_noisy_citations(spark):
    rows = [
        ("AREsp 10.196.000/RR", "AREsp", []), ("HC n.º 6.184.200/RO", "HC", []), ("EDcl no Ag. Reg. no Rec. Esp. nº 1.528.455", "REsp", ["AGRG", "ED"]),
        ("TST-E-ED-Ag-RR-", "RR", ["AGINT", "ED", "EDV"]), ("Emb. Decl. no agravo interno no recurso em habeas corpus", "RHC", ["AGINT", "ED"]), ("AgR-AIRR-1000-10.2015.5.02.0001", "AIRR", ["AGRG"]),
    ]
    df = spark.createDataFrame([(t,) for t, *_ in rows], "t string")
    got = {r["t"]: (r["c"], list(r["m"])) for r in df.select("t", X.class_code(F.col("t")).alias("c"), X.appeal_chain(X.fold(X.before_number(F.col("t")))).alias("m")).collect()}
    assert got == {t: (c, m) for t, c, m in rows}
    years = spark.createDataFrame([(y,) for y in (0, 29, 30, 88, 2015, 150)], "y int")
    assert [r["z"] for r in years.select(X.year4(F.col("y")).alias("z")).collect()] == [2000, 2029, 1930, 1988, 2015, None]


def test_alike_pairs_are_all_pairs_of_words_compared():
    r = random.Random(5)
    words = sorted({"".join(r.choice("abdeiou") for _ in range(r.choice([3, 5, 8, 11, 20, 70]))) for _ in range(80)} | {"a" * 250, "ab" * 130, "", "xbcdefgy"})
    other = []
    for w in words * 4:
        for _ in range(r.randrange(5)):
            k = r.randrange(len(w) + 1)
            w = w[:k] + r.choice(["", "a", "é", "u"]) + w[k + r.randrange(2) :]
        other.append(w)
    other = sorted({*other, "abcdefgh", "a" * 260})
    got = [p for ps in fuzzy.alike_pairs(words, other) for p in ps]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in other if fuzzy.alike(a, b)}
    assert ("xbcdefgy", "abcdefgh") in got
