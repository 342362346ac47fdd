"""Interval operators, key tables, resolution, contract, sources and stream on small tables."""

import random
import re
import sqlite3

from pyspark.sql import functions as F

from citeresolve.functions import fuzzy
from citeresolve.functions import text as X
from citeresolve.operators import canon, contract, extract, resolve, review, spans
from citeresolve.plans import registry
from citeresolve.sources import files as sources


def iou(a, b):
    i = max(0, min(a[1], b[1]) - max(a[0], b[0]))
    return i / (a[1] - a[0] + b[1] - b[0] - i)


def rows(n, seed, width=3000):
    r = random.Random(seed)
    return [(f"d{r.randrange(4)}", s := r.randrange(width), s + r.randrange(1, 200), r.choice([None, 0.5, 0.9]), i) for i in range(n)]


def test_suppress_and_pairs_against_brute_force(spark):
    data = rows(160, 1)
    df = spark.createDataFrame(data, "doc string, s int, e int, c double, id int")
    got = {r["id"] for r in spans.suppress(df, "doc", "s", "e", "c", "id").collect()}
    want = set()
    for d in {x[0] for x in data}:
        kept = []
        for x in sorted((x for x in data if x[0] == d), key=lambda x: (-(x[3] or 0.0), x[1] - x[2], x[1], x[4])):
            if all(iou(k[1:3], x[1:3]) < 0.5 for k in kept):
                kept.append(x)
        want |= {x[4] for x in kept}
    assert got == want
    pairs = {(r["a_id"], r["b_id"]) for r in spans.iou_pairs(df, "doc", "s", "e", "id").collect()}
    assert pairs == {(a[4], b[4]) for a in data for b in data if a[0] == b[0] and a[4] < b[4] and iou(a[1:3], b[1:3]) >= 0.5}


def test_overlap_anti_floor_and_nearest_against_brute_force(spark):
    a, b = rows(80, 2), rows(30, 3)
    x = spark.createDataFrame([(r[0], r[1], r[2], r[4]) for r in a], "doc string, a_s int, a_e int, id int")
    y = spark.createDataFrame([(r[0], r[1], r[2]) for r in b], "doc string, b_s int, b_e int")
    free = {r["id"] for r in spans.overlap_anti(x, y, "doc", size=64).collect()}
    assert free == {r[4] for r in a if not any(r[0] == q[0] and r[1] < q[2] and q[1] < r[2] for q in b)}
    fl = {r["id"]: r["floor"] for r in spans.floor_end(x, y, "doc", "a_s").collect()}
    assert fl == {r[4]: max((q[2] for q in b if q[0] == r[0] and q[2] <= r[1]), default=None) for r in a}
    near = {(r["doc"], r["a_s"], r["a_e"]): r["gap"] for r in spans.nearest(x, y, "doc", 150).collect()}
    gap = lambda r, q: max(0, q[1] - r[2], r[1] - q[2])
    want = {}
    for r in a:
        g = [gap(r, q) for q in b if q[0] == r[0] and gap(r, q) <= 150]
        if g:
            want[r[0], r[1], r[2]] = min(g)
    # an interval of b is met in the block of its start
    assert {k: v for k, v in near.items()} == want


CANON = [
    (1, "STJ", "acordao", 2015, "Fulano de Tal", "RECURSO ESPECIAL Nº 1.528.455 - RJ\nEMENTA. Contrato bancário abusivo."),
    (2, "STJ", "acordao", 2016, "Beltrana Souza", "AgInt no RECURSO ESPECIAL Nº 2.000.001 - SP\nEMENTA."),
    (3, "TST", "acordao", 15, None, "Vistos, relatados e discutidos estes autos de Recurso de revista nº TST-ED-RR-1000-10.2015.5.02.0001\nEMENTA."),
    (4, None, "sumula", None, None, "Súmula Vinculante n. 10 do STF"),
    (5, None, "sumula", None, None, "Súmula n. 83 do STJ"),
    (6, None, "dispositivo", None, None, "Artigo 373 do Código de Processo Civil"),
    (7, None, "dispositivo", None, None, "Artigo 290 do Decreto-Lei nº 1.001, de 21 de outubro de 1969"),
    (8, "STJ", "acordao", None, "", "sem número"),
    (9, "STF", "acordao", 2024, "Fulano de Tal", "RECLAMAÇÃO 76.532\nEMENTA."),
]


def canon_df(spark):
    return spark.createDataFrame(CANON, sources.CANONICAL)


def test_key_tables(spark):
    d = canon_df(spark)
    r = {x["doc_id"]: x for x in canon.rulings(d).collect()}
    assert (r["1"]["numero"], r["1"]["uf"], r["1"]["classe"], r["1"]["chain"]) == (1528455, "RJ", "REsp", [])
    assert r["2"]["chain"] == ["AGINT"]
    assert (r["3"]["seq"], r["3"]["tail"], r["3"]["ano"]) == (1000, "1020155020001", 2015)
    assert r["9"]["numero"] == 76532
    assert {(x["tribunal"], x["numero"], x["vinculante"]) for x in canon.sumulas(d).collect()} == {("STF", 10, True), ("STJ", 83, False)}
    assert {(x["diploma"], x["artigo"]) for x in canon.dispositivos(d).collect()} == {("CPC", 373), ("CPM", 290)}
    assert [x["id"] for x in canon.unindexed(d).collect()] == [8]


def resolved(spark, *trechos):
    d = canon_df(spark)
    m = spark.createDataFrame([(t, t, "lei" if t.lower().startswith("art") else "jurisprudencia", "") for t in trechos], "cit string, trecho string, tipo string, contexto string")
    return {r["cit"]: (r["regra"], r["id_canonico"]) for r in resolve.resolve(m, canon.rulings(d), canon.sumulas(d), canon.dispositivos(d)).collect()}


def test_resolution_scenarios(spark):
    want = {
        "REsp 1.528.455/RJ": ("real_exato", "1"),
        "REsp 1.528.4S5/RJ": ("real_ocr", "1"),
        "REsp 1.528.456/RJ": ("inventada", None),
        "AgInt no REsp 1.528.455/RJ": ("real_cadeia_divergente", "1"),
        "REsp 1.528.455/SP": ("inventada", None),
        "RE 1.528.455": ("inventada", None),
        "REsp": ("incompleta_sem_numero", None),
        "ED-RR-1000-10.2015.5.02.0001": ("real_exato", "3"),
        "Súmula 83 do STJ": ("real_exato", "5"),
        "Súmula Vinculante 10": ("real_exato", "4"),
        "Súmula 84 do STJ": ("inventada", None),
        "art. 373, I, do CPC": ("real_exato", "6"),
        "art. 374 do CPC": ("inventada", None),
        "art. 373 do CPC/73": ("inventada", None),
        "precedente do STF de 2024, da relatoria de Fulano de Tal": ("real_descritiva", "9"),
        "precedente do STF de 2023, da relatoria de Fulano de Tal": ("incompleta_descritiva_sem_registro", None),
        "Tema 1.046 da repercussão geral": ("inventada", None),
    }
    assert resolved(spark, *want) == want


def test_headers_of_other_shapes(spark):
    rows = [
        (1, "TSE", "acordao", 30, None, "RECURSO ORDINÁRIO Nº 839-42. 2010.6.19.0000/RO\nEMENTA."), (2, "TST", "acordao", None, None, "Vistos, relatados e discutidos estes autos de Recurso de revista nº TST-ED-Ag-RR-1000-10.2015.5.02.0001\nno autos 1-11.2011.5.01.0001"),
        (3, "STF", "acordao", None, None, "AÇÃO RESCISÓRIA 2.614 DISTRITO FEDERAL\nRELATORA: X"), (4, "STJ", "acordao", None, None, "RECURSO ESPECIAL Nº 7.188.400 - RR"), (5, None, "dispositivo", None, None, "Artigo 1.022 do Código de Processo Civil"), (6, None, "dispositivo", None, None, "Artigo 5º da Constituição Federal"),
        (7, "STJ", "sumula", None, None, "SÚMULA 7"), (8, None, "sumula", None, None, "sem número"),
    ]
    d = spark.createDataFrame(rows, sources.CANONICAL)
    r = {x["doc_id"]: (x["seq"], x["numero"], x["uf"], x["classe"], list(x["chain"]), x["ano"]) for x in canon.rulings(d).collect()}
    assert r == {"1": (839, None, "RO", "RO", [], 1930), "2": (1000, None, None, "RR", ["AGINT", "ED"], None), "3": (None, 2614, None, "AR", [], None), "4": (None, 7188400, "RR", "REsp", [], None)}
    assert {(x["diploma"], x["artigo"]) for x in canon.dispositivos(d).collect()} == {("CPC", 1022), ("CF", 5)}
    assert {(x["tribunal"], x["numero"]) for x in canon.sumulas(d).collect()} == {("STJ", 7)} and [x["id"] for x in canon.unindexed(d).collect()] == [8]


def test_resolution_of_broken_repeated_and_unreadable_mentions(spark):
    want = {
        "REsp 1.528.45": ("incompleta_sem_numero", None), "REsp 1.528.455/": ("incompleta_sem_numero", None), "ED-RR-1000-10.2015.5.02.00": ("incompleta_sem_numero", None), "Súmula n. 83 do ST": ("incompleta_sem_numero", None),
        "REsp 1 528 455": ("real_ocr", "1"), "PRECEDENTE DO STF DE 2024, DA RELATORIA DE FULAMO DE TAL": ("real_descritiva", "9"), "Rcl de 2024, Rel. Min. Fulano Tal": ("real_descritiva", "9"), "Rcl do STF de 2024, Rel. Min. Beltrano Tal": ("incompleta_descritiva_sem_registro", None),
    }
    assert resolved(spark, *want) == want
    d = canon_df(spark)
    m = spark.createDataFrame([(f"m{i}", "REsp 1.528.455/RJ", "jurisprudencia", "", "") for i in range(40)] + [("x", None, "jurisprudencia", None, None), ("y", "REsp 1.528.455", "jurisprudencia", None, ", Rel. Min. Outra Pessoa, julgado")], "cit string, trecho string, tipo string, contexto string, depois string")
    got = {r["cit"]: (r["regra"], r["confianca"]) for r in resolve.resolve(m, canon.rulings(d), canon.sumulas(d), canon.dispositivos(d)).collect()}
    assert len(got) == 42 and got["m7"] == ("real_exato", 0.98) and got["x"] == ("erro_interno", 0.4) and got["y"][0] == "real_atributo_divergente"


def test_equal_records_are_told_apart_by_their_context(spark):
    d = spark.createDataFrame([(i, "STJ", "acordao", 2015, None, f"RECURSO ESPECIAL Nº 1.528.455 - RJ\nEMENTA. {t}") for i, t in ((11, "contrato bancário abusivo"), (2, "dano ambiental coletivo"), (30, "dano ambiental coletivo"))], sources.CANONICAL)
    m = spark.createDataFrame([("a", "REsp 1.528.455/RJ", "jurisprudencia", "sobre contrato bancário"), ("b", "REsp 1.528.455/RJ", "jurisprudencia", "sobre dano ambiental"), ("c", "REsp 1.528.455/RJ", "jurisprudencia", None)], "cit string, trecho string, tipo string, contexto string")
    got = {r["cit"]: (r["id_canonico"], r["regra"]) for r in resolve.resolve(m, canon.rulings(d), canon.sumulas(d), canon.dispositivos(d)).collect()}
    assert got == {"a": ("11", "real_duplicata"), "b": ("2", "real_duplicata"), "c": ("2", "real_duplicata")}


def test_a_changed_digit_is_never_real(spark):
    r = random.Random(5)
    many = set()
    for _ in range(12):
        d = list("1528455")
        k = r.randrange(7)
        d[k] = r.choice([c for c in "0123456789" if c != d[k]])
        s = "".join(d)
        many.add(f"REsp {s[0]}.{s[1:4]}.{s[4:]}/RJ")
    assert all(v[0].startswith("inventada") for v in resolved(spark, *many).values())


def test_extraction_offsets_and_cleaning():
    t = "Aplica-se a Súmula 83 do STJ e o AgInt no REsp n.º 1.528.455/RJ, e o art. 373, I, do CPC. O presente REsp 1.111.111 segue."
    got = [t[s:e] for s, e, *_ in extract.spans(t)]
    assert got == ["Súmula 83 do STJ", "AgInt no REsp n.º 1.528.455/RJ", "art. 373, I, do CPC"]
    c, at = extract.clean("Recur-\nso​.. Ã§")
    assert c == "Recurso. ç" and len(at) == len(c) + 1
    assert extract.clean("texto limpo, sem ruído.") == ("texto limpo, sem ruído.", list(range(24)))
    assert extract.spans("") == [] and extract.spans("jurisprudência pacífica desta Corte; Lei nº 13.467/2017") == []


def test_spans_are_widened_and_descriptions_found():
    def found(t):
        return [(t[s:e], f) for s, e, f, *_ in extract.spans(t)]

    assert found("STJ, EDcl no Ag. Reg. no Rec. Esp. nº 1.528.455/SP (STJ), Agravo Interno, Embargos de Declaração. E Súmula 331, IV, do TST.") == [("STJ, EDcl no Ag. Reg. no Rec. Esp. nº 1.528.455/SP (STJ), Agravo Interno, Embargos de Declaração", "processos"), ("Súmula 331, IV, do TST", "sumulas")]
    assert found("REsp 2019, Rel. Min. Beltrano, STJ.") == [("REsp 2019, Rel. Min. Beltrano, STJ", "julgados_descritivos")]
    assert found("conforme a relatoria de Fulano de Tal, o STF em 2019 decidiu") == [("relatoria de Fulano de Tal, o STF em 2019", "julgados_descritivos")]
    assert found("o recurso espe cial nº 1.234.567/RJ, julgado ontem, e o REsp 1.111.222/SP, AgInt no REsp 3.333.444/SP") == [("recurso espe cial nº 1.234.567/RJ", "processos"), ("REsp 1.111.222/SP", "processos"), ("AgInt no REsp 3.333.444/SP", "processos")]
    assert found("Autos nº 0005153-84.2012.8.31.5000, CPF 12345678, às fls. 12.345, recurso de 123456 reais") == []
    assert found("CPM, art. 290, incisos I a III, e art. 5º da Lei 8.078 de 1990") == [("CPM, art. 290, incisos I a III", "artigos"), ("art. 5º da Lei 8.078 de 1990", "artigos")]
    assert extract.contained_out([(0, 9, "b"), (2, 5, "a"), (4, 12, "c"), (4, 12, "d")]) == [(0, 9, "b"), (4, 12, "c")]


def test_islands(spark):
    df = spark.createDataFrame([("d", 0, 5), ("d", 3, 8), ("d", 8, 9), ("d", 20, 30), ("d", 22, 24), ("e", 1, 2)], "doc string, s int, e int")
    assert sorted((r["s"], r["island"]) for r in spans.islands(df, "doc", "s", "e").where("doc = 'd'").collect()) == [(0, 0), (3, 0), (8, 8), (20, 20), (22, 20)]


def test_extract_handles_null_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "", 2), ("c", "Súmula 7 do STJ " * 500, 3)], "documento_id string, text string, inicio int")
    got = extract.extract(df, "documento_id", "text")
    assert got.count() == 500 and got.where("fim <= inicio").count() == 0
    assert extract.extract(df.limit(0), "documento_id", "text").count() == 0


def test_contract(spark):
    docs = spark.createDataFrame([("a", "REsp 1 e REsp 2"), ("b", "nada"), ("n", None)], "documento_id string, text string")
    c = spark.createDataFrame(
        [("a", 0, 6, "REsp 1", "lei", "real", "1", 0.9), ("a", 0, 5, "REsp 1", "x", "y", None, 1.5), ("a", 9, 99, "REsp 2", "lei", "inventada", "1", None), ("z", 0, 1, "R", "lei", "real", "77", 0.1)],
        "documento_id string, inicio int, fim int, trecho string, tipo string, classificacao string, id_canonico string, confianca double",
    )
    v = {r["regra_violada"] for r in contract.violations(c, docs, canon_df(spark)).collect()}
    assert v == {"V1", "V3", "V4", "V5", "V6", "V7", "V8", "V9", "V10", "V11", "V12"}
    p = {r["documento_id"]: r["citacoes"] for r in contract.packed(c, docs).collect()}
    assert p["b"] == "-" and p["a"].startswith("0,5,y,-,1.5000|0,6,real,1,0.9000|9,99,inventada,1,-")
    assert contract.nested(c).count() == 2


def test_review(spark):
    v = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2")], "cit string, id_canonico string")
    votes = {r["cit"]: r["id_canonico"] for r in review.vote(v).collect()}
    assert votes == {"a": "1", "b": None}
    c = spark.createDataFrame([("a", "inventada", None, 0.97, "inventada"), ("b", "inventada", None, 0.97, "inventada"), ("c", "real", "9", 0.98, "real_exato")], "cit string, classificacao string, id_canonico string, confianca double, regra string")
    s = {r["cit"]: (r["regra"], r["id_canonico"]) for r in review.settle(c, review.vote(v)).collect()}
    assert s == {"a": ("real_nlp", "1"), "b": ("inventada", None), "c": ("real_exato", "9")}
    b = spark.createDataFrame([(i, 100.0 if i == 0 else 50.0) for i in range(8)], "n int, s double")
    assert [r["active"] for r in review.within_budget(b, "n", "s").orderBy("n").collect()] == [True] * 4 + [False] * 4


def test_readings_are_placed_at_every_occurrence(spark):
    from citeresolve.functions import fuzzy

    assert fuzzy.places("o HC 1.234 e o HC 1.234 e o HC l.234", ["HC 1.234", "RE 9.999"]) == [(0, 2, 10), (0, 15, 23), (0, 28, 36)]
    t = "HC 1.234\n" + "x" * 80 + "\no HC 1.234 e depois o HC 1.234, e o REsp 9.876.543"
    r = spark.createDataFrame([("d", "m", "HC 1.234", None, "d:m:HC 1.234"), ("d", "m", "nada disso", None, "d:m:nada disso"), ("d", "m", "REsp 9.876.S43", None, "r")], "documento_id string, modelo string, trecho string, numero string, reading string")
    docs = spark.createDataFrame([("d", t), ("d", t)], "documento_id string, text string")
    at = review.placed(r, docs)
    first, second = t.index("HC 1.234", 5), t.rindex("HC 1.234")
    assert sorted((x["inicio"], x["trecho"]) for x in at.collect()) == [(0, "HC 1.234"), (first, "HC 1.234"), (second, "HC 1.234"), (t.index("REsp"), "REsp 9.876.S43")]
    own = spark.createDataFrame([], "documento_id string, numbers array<string>")
    p = review.precise(at.where("reading <> 'r'"), review.header_end(docs.distinct(), "documento_id", "text"), own)
    assert sorted(x["inicio"] for x in p.collect()) == [first, second]
    c = spark.createDataFrame([("d", first, first + 8, "c1")], "documento_id string, inicio int, fim int, cit string")
    left = p.join(review.matched(p, c).select("place"), "place", "left_anti")
    assert [(x["inicio"], x["place"]) for x in left.collect()] == [(second, f"d:m:HC 1.234:{second}:{second + 8}")]


def test_names_numbers_and_evidence():
    from citeresolve.functions import fuzzy

    names = frozenset(["murebira", "solsastedo"])
    s, at = extract.split_names("Rel. MurebiraSolsastedo", list(range(24)), names)
    assert s == "Rel. Murebira Solsastedo" and len(at) == len(s) + 1
    assert extract.own_numbers("SENTENÇA\nAutos nº 0004417-82.2018.8.61.0014\n") == ["00044178220188610014"]
    known = frozenset([frozenset(["fulana", "murebira"])])
    t = "da relatoria de Beltrano Souza, e Fulana Murebira votou"
    assert [(t[a:b], h) for a, b, h in extract.relator_mentions(t, known)] == [("Beltrano Souza", "cue"), ("Fulana Murebira", "known")]
    assert fuzzy.fuzzy_in("Murebira", "voto de Murebiro") and not fuzzy.fuzzy_in("Murebira", "voto")
    assert fuzzy.evidence("no REsp 1", "REsp") == 4 and fuzzy.evidence("no HC 1", "REsp") == 0
    assert fuzzy.best_evidence("art. 1 do código de processo civil", ["CPC", "CF"]) == "CPC" and fuzzy.best_evidence("nada", ["CPC"]) is None
    assert fuzzy.cited_number("no AgInt no REsp nº") and not fuzzy.cited_number("às fls.") and not fuzzy.cited_number("total de um dois três quatro")


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_bytes("linha\r\ndois ç".encode())
    (tmp_path / "t" / "y.md").write_text("não")
    assert [tuple(r) for r in sources.documents(spark, str(tmp_path / "t")).collect()] == [("x", "linha\r\ndois ç")]
    with sqlite3.connect(tmp_path / "c.db") as con:
        con.execute("CREATE TABLE documentos (id INTEGER, tribunal TEXT, natureza TEXT, ano INTEGER, relator TEXT, texto TEXT)")
        con.executemany("INSERT INTO documentos VALUES (?, ?, ?, ?, ?, ?)", CANON)
    got = sources.canonical(spark, str(tmp_path / "c.db"))
    assert got.count() == len(CANON) and got.where("id = 3").first()["tribunal"] == "TST"
    c = spark.createDataFrame([("a", 0, 6, "REsp 1", "lei", "real", "1", 0.9)], "documento_id string, inicio int, fim int, trecho string, tipo string, classificacao string, id_canonico string, confianca double")
    sources.write_packed(contract.packed(c, spark.createDataFrame([("a",), ("b",)], "documento_id string")), str(tmp_path / "p"))
    assert {tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "p")).collect()} == {("a", "0,6,real,1,0.9000"), ("b", "-")}
    sources.write_json(contract.nested(c), str(tmp_path / "j"))
    back = sources.contract_json(spark, str(tmp_path / "j")).collect()
    assert [tuple(r) for r in back] == [("a", 0, 6, "REsp 1", "lei", "real", "1", 0.9)]


def test_stream_equals_batch(spark, tmp_path):
    from citeresolve.streaming import files

    docs = spark.createDataFrame([("a", "REsp 1.528.455/RJ e Súmula 83 do STJ"), ("b", None), ("c", "Tema 7")], "documento_id string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    d = canon_df(spark)
    keys = (canon.rulings(d), canon.sumulas(d), canon.dispositivos(d))
    out = []
    q = files.run(files.document_stream(spark, str(tmp_path / "in"), docs.schema), *keys, lambda b, e: out.extend(tuple(r) for r in b.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(out, key=str) == sorted((tuple(r) for r in resolve.resolve(files.mentions(docs), *keys).collect()), key=str)
    assert len(out) == 3


def test_empty_tables(spark):
    d = canon_df(spark).limit(0)
    m = spark.createDataFrame([], "cit string, trecho string, tipo string, contexto string")
    assert resolve.resolve(m, canon.rulings(d), canon.sumulas(d), canon.dispositivos(d)).count() == 0
    assert canon.unindexed(d).count() == 0 and canon.relators(canon.rulings(d)).count() == 0


def test_plan_pushes_filters_and_prunes_columns(spark, small):
    from citeresolve.session import table

    plan = table(spark, small, "documentos").where(F.col("natureza") == "sumula").select("id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(natureza), EqualTo(natureza,sumula)]" in plan and "texto" not in plan.split("ReadSchema")[-1]


def test_descriptive_names_that_share_no_end_of_a_word_meet(spark):
    docs = spark.createDataFrame([(1, "STF", "acordao", 2024, "Narciso Pelbadot", "EMENTA."), (2, "STF", "acordao", 2024, "Narciso Outrem", "EMENTA.")], "id long, tribunal string, natureza string, ano int, relator string, texto string")
    m = spark.createDataFrame([("a", "julgado do STF de 2024, da relatoria de Belbador", "jurisprudencia", None), ("b", "julgado do STF de 2024, da relatoria de Narciso", "jurisprudencia", None)], "cit string, trecho string, tipo string, contexto string")
    got = {r["cit"]: (r["regra"], r["id_canonico"]) for r in resolve.descriptive_mentions(resolve.family(m), canon.rulings(docs)).collect()}
    assert got == {"a": ("real_descritiva", "1"), "b": ("incompleta_descritiva", None)}


def test_alike_names_are_all_names_compared_in_groups(spark):
    r = random.Random(11)
    parts = ["".join(r.choice("abelmort") for _ in range(r.randrange(3, 11))) for _ in range(12)]

    def name():
        out = set()
        for w in r.sample(parts, r.randrange(1, 4)):
            k = r.randrange(len(w))
            out.add(r.choice([w, w[:k] + "x" + w[k:], w[:k] + w[k + 1 :] or w]))
        return sorted(out)

    asked, known = ([(r.choice(["STF", "STJ", None]), r.choice([2001, 2002]), name()) for _ in range(n)] + [("STF", 2001, []), ("STF", None, ["abel"])] for n in (120, 150))
    a, k = (spark.createDataFrame(x, f"tribunal string, ano int, {c} array<string>") for x, c in ((asked, "nome"), (known, "r_nome")))
    got = [(x[0], x[1], tuple(x[2]), tuple(x[3])) for x in resolve.alike_names(a, k, ["tribunal", "ano"]).collect()]
    want = {(t, y, tuple(c), tuple(n)) for t, y, c in asked for u, z, n in known if t and y and (t, y) == (u, z) and fuzzy.names_match(c, n)}
    assert want and len(got) == len(set(got)) and set(got) == want


def test_fuzzy_name_match_counts_every_record(spark, small):
    c, r = registry.cits(spark, small), registry.keys(spark, small)[0].where("relator IS NOT NULL")
    m = resolve.family(c).where("familia = 'descritivos'").select("cit", "trecho", X.courts_in(F.col("trecho")).alias("t"), X.name_tokens(F.regexp_extract("trecho", r"(?:relatoria d[aeo]s?|Rel\.|Relatora?:?)\s+(.+)$", 1)).alias("c")).collect()
    known = r.select("tribunal", "ano", "doc_id", X.name_tokens(F.col("relator")).alias("r")).collect()
    want = {}
    for x in m:
        y = re.search(r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", x["trecho"])
        ids = [k["doc_id"] for k in known if x["t"] and y and k["tribunal"] == x["t"][0] and k["ano"] == int(y.group(1)) and fuzzy.names_match(x["c"], k["r"])]
        if ids:
            want[x["cit"]] = (len(ids), min(ids))
    got = registry.fuzzy_name_match(spark, small)
    assert want and {x["cit"]: (x["records"], x["doc_id"]) for x in got.collect()} == want
    # names are compared by their words, not as pairs of a court and a year
    assert "name_matches" not in got._jdf.queryExecution().toString()


def test_texts_around_are_fetched_for_ties_alone(spark):
    d = spark.createDataFrame([(i, "STJ", "acordao", 2015, None, f"RECURSO ESPECIAL Nº 1.528.{n} - RJ\nEMENTA. {t}") for i, n, t in ((1, 455, "Contrato bancário abusivo."), (2, 455, "Guarda compartilhada."), (3, 456, "Outro."))], sources.CANONICAL)
    m = spark.createDataFrame([("a", "REsp 1.528.455/RJ", "jurisprudencia", None), ("b", "REsp 1.528.456/RJ", "jurisprudencia", None)], "cit string, trecho string, tipo string, contexto string")
    asked = []

    def around(few):
        asked.extend(r["cit"] for r in few.collect())
        return few.withColumn("contexto", F.lit("sobre guarda compartilhada"))

    got = {r["cit"]: r["id_canonico"] for r in resolve.resolve(m, canon.rulings(d), canon.sumulas(d), canon.dispositivos(d), around).collect()}
    assert got == {"a": "2", "b": "3"} and asked == ["a"]
