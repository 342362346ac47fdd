"""Training-data operators: round trips, brute force, accuracy, and nulls, empties, repeats, ties, empty tables, clashing columns."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from citeresolve.llm import abuse, bpe, mix, mojibake, names, scans, split, unify
from citeresolve.llm.rows import pieces, weight

# ---- 1


def test_unify_forms(spark):
    same = [("A ação é ﬁnal nº 10", "A ação é final nº 10"), ("R$ 5", "Ｒ＄ ５"), ("peso", "ре​ѕо"), ("a-b", "a‑b"), ("Ⅳ", "IV"), ("a\nb", "a\r\nb")]
    other = [("m²", "m2"), ("a  b", "a b"), ("avô", "avó"), ("A", "a"), ("a\nb", "a b"), ("“a”", '"a"'), ("½", "1/2"), ("1º", "1o"), ("a–b", "a-b")]
    rows = [(2 * i + k, t) for i, p in enumerate(same + other) for k, t in enumerate(f"{i}: {x}" for x in p)]
    df = spark.createDataFrame(rows, "i long, t string")
    got = {(r["a"], r["b"]) for r in unify.same_looking_pairs(df, "i", "t", "a", "b").collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(len(same))}


def test_unify_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "​", "x"), (4, "ação", "x"), (4, "ação", "y"), (5, "ação", "x"), (5, "ação", "z"), (None, "ação", "x"), (6, "ção " * 20000, "x")]
    df = spark.createDataFrame(rows, "i long, t string, canon string")
    assert [tuple(r) for r in unify.same_looking_pairs(df, "i", "t", "a", "b").collect()] == [(4, 5)]
    u = {(r["i"], r["canonico"]) for r in unify.unify(df, "i", "t").collect()}
    assert (1, None) in u and (2, "") in u and (3, "") in u and (5, "ação") in u
    assert unify.same_looking_pairs(df.limit(0), "i", "t", "a", "b").count() == 0


def test_words_of_another_script_stay(spark):
    rows = [(1, "Россия и СССР assinaram o асordо"), (2, "реѕо"), (3, "О СССР"), (4, "Poccия")]
    df = spark.createDataFrame(rows, "i long, t string")
    got = {r["i"]: r["canonico"] for r in unify.unify(df, "i", "t").collect()}
    assert got == {1: "Россия и СССР assinaram o acordo", 2: "peso", 3: "O CCCP", 4: "Poccия"}
    assert {tuple(r) for r in unify.same_looking_pairs(df.union(spark.createDataFrame([(9, "Россия")], "i long, t string")), "i", "t", "a", "b").collect()} == {(4, 9)}


def test_unify_classes(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a\u00a0b"), (3, "a b"), (4, "c")], "i long, t string")
    c = unify.classes(df, "i", "t").collect()
    assert {(r["i"], r["representante"], r["formas"], r["linhas"]) for r in c} == {(1, 1, 2, 3), (3, 1, 2, 3), (2, 2, 2, 3)}


def test_unify_hot_text_pairs_each_other_form(spark):
    df = spark.range(300).select(F.col("id").alias("i"), F.when(F.col("id") == 7, "a b").otherwise("a b").alias("t"))
    assert unify.same_looking_pairs(df, "i", "t", "a", "b").count() == 299


# ---- 2


def corpus():
    body = "o autor registrou em cartório o contrato de locação e o recurso foi provido. a parte contrária juntou o guarda-volumes ao processo principal"
    return [x for i in range(60) for x in (body, f"Diário da Justiça — caderno {i}\n- {i} -\n{body}")]


def reader(texts=None):
    c = scans.Counts()
    for t in texts or corpus():
        c.add(t)
    return scans.Reader.of(r for r in c.rows() if r[3] >= {"w": 2, "p": scans.KNOWN, "h": 4}[r[0]] and (r[0] != "h" or r[4] >= 0.4 * r[3]))


def test_scan_traces_and_repair():
    r = reader()
    t = "o autor reqistrou em cart0rio o con-\ntrato de\nlocação\n- 12 -\nDiário da Justiça — caderno 7\ne o recurso foi provido."
    assert r.traces(t) == ["furniture", "cut", "misread"]
    assert r.repair(t)[0] == "o autor registrou em cartório o contrato de locação e o recurso foi provido."
    for clean in ("o autor registrou\nem cartório o contrato", "a parte juntou o guarda-\nvolumes ao processo", "", "1. o autor;\n2. o recurso;"):
        assert r.repair(clean) == (clean, [])


def test_candidates_are_complete_within_the_budget():
    r = reader()
    conf = {}
    for cost, pairs in scans.CONFUSED.items():
        for p in pairs.split():
            a, b = p.split(":")
            conf.setdefault(a, []).append((b, cost))

    def cost(printed, read):  # brute force over all ways to misread
        best = {0: {0: 0.0}}
        for i in range(len(printed)):
            for j, v in best.get(i, {}).items():
                if j < len(read) and printed[i] == read[j]:
                    best.setdefault(i + 1, {})[j + 1] = min(v, best.get(i + 1, {}).get(j + 1, 9.0))
                for n in (1, 2):
                    for b, c in conf.get(printed[i : i + n], []):
                        if len(printed[i : i + n]) == n and read.startswith(b, j):
                            k = j + len(b)
                            best.setdefault(i + n, {})[k] = min(v + c, best.get(i + n, {}).get(k, 9.0))
        return best.get(len(printed), {}).get(len(read), 9.0)

    for word in ("reqistrou", "cart0rio", "corifrofo", "rccurso", "autor", "pracesso", "xyz"):
        budget = min(3.0, max(0.6, 0.34 * len(word)))
        want = {w for w, n in r.count.items() if n >= scans.KNOWN and "-" not in w and w != word and cost(w, word) <= budget + 1e-9}
        assert {w for _, w in r.candidates(word)} == want


def test_candidates_with_one_edit_are_complete():
    from functools import cache

    r = reader()
    conf = [(*p.split(":"), cost) for cost, pairs in scans.CONFUSED.items() for p in pairs.split()]

    def cost(printed, read):  # brute force over all ways to misread with one other edit
        @cache
        def go(i, j, e):
            ways = [0.0] if i == len(printed) and j == len(read) else []
            if i < len(printed) and j < len(read) and printed[i] == read[j]:
                ways.append(go(i + 1, j + 1, e))
            ways += [c + go(i + len(a), j + len(b), e) for a, b, c in conf if printed.startswith(a, i) and read.startswith(b, j)]
            if e:
                ways += [scans.EDIT + go(i + x, j + y, 0) for x, y in ((1, 0), (0, 1), (1, 1)) if i + x <= len(printed) and j + y <= len(read)]
            return min(ways, default=9.0)

        return go(0, 0, 1)

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, one = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y)))
        return row[-1]

    vocabulary = {w for w, n in r.count.items() if n >= scans.KNOWN and "-" not in w}
    for word in ("xregistrou", "regisrou", "registtrou", "registroux", "reqisrou", "cortrato", "ontrato", "autores", "pracessos", "xyz", "recuxrso"):
        got = {w for _, w in r.candidates(word, 1)}
        assert got == {w for w in vocabulary if w != word and cost(w, word) <= min(3.0, max(0.6, 0.34 * len(word))) + 1e-9}
        assert {w for w in vocabulary if w != word and lev(w, word) <= 1} <= got
    t = "o autor regisrou em cartório o conntrato de locação e o rexurso foi provido."
    assert r.traces(t) == ["misread"]
    assert r.repair(t)[0] == "o autor registrou em cartório o contrato de locação e o recurso foi provido."
    assert r.traces("juntou o guarda-volumes ao process") == []  # cut off, not misread


def test_long_words_are_looked_up():
    long = "pneumoultramicroscopicossilicovulcanoconiótico"
    r = reader([f"o quadro {long} do autor"] * 30)
    assert len(long) > 40 and r.repair(f"o quadro {long.replace('vulc', 'vnlc')} do autor")[0] == f"o quadro {long} do autor"


def test_misreadings_of_rare_words_are_corrected():
    r = reader(["a testemunha depôs ontem"] * 5 + ["o réu descumpriu o contrato"] * 400 + ["o réu descnmpriu o contrato"] * 3 + ["a testemnnha depôs ontem e o réu dcscnmpriu o contrato"])
    assert r.correction("testemnnha", "a", "depôs") == "testemunha"
    assert r.correction("dcscnmpriu", "réu", "o") == "descumpriu"  # not the frequent misreading nearer to it


def test_scan_statistics_keep_rare_words_of_a_large_corpus(spark):
    many = " ".join(["processo"] * 50_000)
    df = spark.createDataFrame([(i, many) for i in range(40)] + [(100 + i, "a testemunha depôs") for i in range(3)], "id long, t string")
    got = {(r["kind"], r["a"], r["b"]) for r in scans.statistics(df).collect()}
    assert {("w", "testemunha", None), ("p", "a", "testemunha"), ("p", "testemunha", "depôs")} <= got


def test_words_of_cut_chains():
    got = scans.cut_words("o con-\ntra-\nto e o guarda-\nvolumes")
    assert {"con", "tra", "to", "contra", "trato", "contrato", "contra-to", "con-trato", "guardavolumes", "guarda-volumes"} <= got


@pytest.fixture
def noisy():
    out = list(enumerate(corpus()))
    cut = "Diário da Justiça — caderno 7\n"
    out += [(900, "o autor reqistrou em cart0rio o con-\ntrato de\nlocação\n- 12 -\n" + cut + "e o recurso foi provido."), (901, "o autor registrou em cartório o con-\n" + cut + "- 8 -\ntrato de locação")]
    out += [(902, "o autor regisrou em cartório o conntrato de locação e o rexurso foi provido."), (903, "o autor registrou\nem cartório o contrato"), (904, "juntou o guarda-\nvolumes ao processo"), (905, "palavra desconhecida xyzt"), (906, "o au-\nto-\nr registrou"), (907, None), (908, ""), (900, out[-1][1])]
    return out[:-1]


def test_tables_decide_as_the_corpus_in_memory(spark, noisy, monkeypatch):
    df = spark.createDataFrame(noisy + noisy[-9:], "i long, t string")
    r = reader([t for _, t in noisy if t])
    want = {i: (k, x) for i, t in noisy if t for x, k in [r.repair(t)] if k}
    got = {x["i"]: (list(x["traces"]), x["repaired"]) for x in scans.read(df, "i", "t").collect()}
    assert got == want and {900, 901, 902} <= set(want) and not {903, 904, 905} & set(want)
    # nothing held by every worker, and several shards
    monkeypatch.setattr(scans, "SHARD", 12)
    monkeypatch.setattr(scans, "LOOKUPS", 3)
    got = {x["i"]: (list(x["traces"]), x["repaired"]) for x in scans.read(df, "i", "t", top_words=2, top_heads=0).collect()}
    assert got == want


def test_shards_retrieve_what_one_trie_does(spark, monkeypatch):
    words = sorted({w for t in corpus() for w in scans.WORD.findall(t.lower())})
    trie = scans.Trie(words)
    asked = ["reqistrou", "rnnto", "contratto", "xregistrou", "ontrato", "a", "ri", "recuno"]
    monkeypatch.setattr(scans, "SHARD", 4)
    v = spark.createDataFrame([(w, 9) for w in words], "word string, n long")
    got = scans.retrieve(spark.createDataFrame([(w,) for w in asked], "word string"), v, 1).collect()
    same = lambda cs: [c if c is not None and c == c else None for c in cs]
    assert {r["word"]: {o["w"]: same(o["costs"]) for o in r["options"]} for r in got} == {w: a for w in asked if (a := scans.accepted(trie.root, w, 1))}


def test_answers_come_in_bounded_pieces():
    words = {"a" * 8 + x: 9 for x in "bcdefghijk"}
    rows = [(0, False, w, n) for w, n in words.items()] + [(0, True, "a" * 8 + chr(945 + k), 0) for k in range(25)]
    search = lambda root, count, w, n: [(w, [{"w": x, "n": count[x], "costs": c} for x, c in scans.accepting(root, w, 1)])]
    got = list(pieces(scans.answers(rows, search), ["word", "options"], 1000, 700))
    assert len(got) > 10 and all(len(p) == 1 or sum(map(weight, p.itertuples(index=False))) <= 700 for p in got)
    assert [w for p in got for w in p["word"]] == [w for _, asked, w, _ in rows if asked] and all(len(o) == 10 for p in got for o in p["options"])
    assert [len(p) for p in pieces(((k,) for k in range(7)), ["k"], 3)] == [3, 3, 1] and not list(pieces((), ["k"]))


def test_words_overshadowed_by_frequent_ones(spark, monkeypatch):
    n = {"recurso": 9000, "recuiso": 12, "recuno": 3, "autor": 400, "aut0r": 21, "aulor": 20, "autoi": 500, "xyzw": 3, "1234": 3, "l234": 9000}
    v = spark.createDataFrame(list(n.items()), "word string, n long")
    trie = scans.Trie(n)
    want = {w for w in n if not w.isdigit() and any(n[x] >= scans.RATIO * n[w] for x in scans.accepted(trie.root, w, 0))}
    assert {r["word"] for r in scans.overshadowed(v).collect()} == want and "aulor" in want and "aut0r" not in want
    monkeypatch.setattr(scans, "SHARD", 2)
    monkeypatch.setattr(scans, "LOOKUPS", 1)
    assert {r["word"] for r in scans.overshadowed(v).collect()} == want


def test_scan_query_handles_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "fl. 237\no autor", 0), (3, "fl. 237\no autor", 1)], "i long, t string, traces int")
    assert [(r["i"], list(r["traces"])) for r in scans.read(df, "i", "t").collect()] == [(3, ["furniture"])]
    assert scans.read(df.limit(0), "i", "t").count() == 0


# ---- 3

CLEAN = ["A decisão não considerou a prova pericial, e a ação foi extinta à revelia do réu. É o relatório.", "Às fls. 20, a petição nº 3 pede a citação do cônjuge e a avaliação do imóvel.", "O título executivo é líquido; a seguradora pagou a indenização — § 2º do contrato."]


def hmm():
    from collections import Counter

    ch = Counter()
    for t in CLEAN * 50:
        ch.update(mojibake.triples(t))
    return mojibake.Model([(*k, n) for k, n in ch.items()])


@pytest.mark.parametrize("pair", ["utf-8>cp1252", "utf-8>cp850", "utf-8>cp437", "utf-8>mac-roman", "cp1252>cp850", "cp1252>mac-roman", "utf-8>cp1252 twice"])
def test_encoding_round_trip(pair):
    m, f = hmm(), mojibake.PAIRS[pair]
    for t in CLEAN:
        bad = "".join(f(c) or c if c > "\x7f" else c for c in t)
        got, states = m.restore(bad)
        assert got == t and states
        half = t + " " + bad
        assert m.restore(half)[0] == t + " " + t


def test_replaced_and_clean_characters():
    m = hmm()
    known = {"decis�o": "decisão", "n�o": "não", "guarda-p�": "guarda-pó", "p�": "pó"}
    t, states = m.restore("A decis�o N�O considerou o vira-p�")
    assert states == ["replaced"] and mojibake.filled(t, known) == "A decisão NÃO considerou o vira-pó"
    for t in [*CLEAN, "Große Straße e o navio Þórunn, £ 900 e € 1.200", "a b­c", ""]:
        assert m.restore(t) == (t, [])


def test_encoding_query(spark):
    rows = [(i, t, None) for i, t in enumerate(CLEAN * 5)] + [(90, None, 1), (91, "", 1), (92, "A petiÃ§Ã£o nÃ£o", 1), (93, "A peti��o n�o", 1)]
    df = spark.createDataFrame(rows, "i long, t string, states int")
    got = {r["i"]: (r["restored"], len(r["states"])) for r in mojibake.repair(df, "i", "t").collect()}
    assert got[90] == (None, 0) and got[91] == ("", 0) and got[92] == ("A petição não", 1) and got[93] == ("A petição não", 1)
    assert {r["i"] for r in mojibake.found(df, "i", "t").collect()} == {92, 93}
    assert mojibake.repair(df.limit(0), "i", "t").count() == 0


# ---- 4

SAME = ["Olívia Clara da Brinjemira Naprirmonte", "OLIVIA CLARA BRINJEMIRA NAPRIRMONTE", "Min.ª O. C. Brinjemira Naprirmonte", "Naprirmonte, Olívia Clara Brinjemira", "Olívia Clara Brinjemria-Naprirmonte", "Olívia Brinjemira Naprirmonte - convocada", "Olívia Clara Brinjemira Naprirmonte, rel. p/ acórdão"]
OTHERS = ["Otávio Brinjemira Naprirmonte", "Olívia Clara Brinjemira Naprirmonte Neto", "Gabriela Luz Ponorrilde", "Gabriel Luz Ponorrilde", "Núcleo de Conciliação da Brinjemira Naprirmonte", "NÃO INFORMADO", "Presidência do Tribunal", "", None]


def test_names_are_linked_and_relatives_are_not(spark):
    df = spark.createDataFrame([(x, "k") for x in SAME + OTHERS + SAME], "relator string, node string")
    nick = spark.createDataFrame([("Chico", "Francisco")], "apelido string, nome string")
    e = names.entities(df, nick)
    got = {(r["a"], r["b"]) for r in names.entity_pairs(e, "a", "b").collect()}
    assert got == {(a, b) for a in SAME for b in SAME if a < b}
    assert names.entities(df.limit(0), nick).count() == 0


def test_abbreviated_names_meet_all_they_stand_for(spark):
    given, middle = ["Jose", "Joaquim", "Jorge", "Juliano", "Jeronimo"], ["Carlos", "Cesar", "Cristiano", "Celestino"]
    many = ["J. C. A. Lima"] + [f"{g} {m} {a} Lima" for g in given for m in middle for a in ("Almeida", "Albuquerque", "Andrade")]
    n = spark.createDataFrame([(names._pack(names.parse(x)),) for x in many], "node string")
    got = {(r["a"], r["b"]) for r in names.links(n, []).select("a", "b").collect()}
    one = names._pack(names.parse(many[0]))
    assert {b if a == one else a for a, b in got if one in (a, b)} == {names._pack(names.parse(x)) for x in many[1:]}


def test_a_tied_spelling_is_an_entity_of_its_own(spark):
    df = spark.createDataFrame([("José Carlos Almeida Lima",), ("João Cesar Moura Lima",), ("J. C. Lima",), ("Min. J. C. Lima",)], "relator string")
    nick = spark.createDataFrame([], "apelido string, nome string")
    e = names.entities(df, nick)
    assert {r["raw"] for r in e.collect()} == {r["relator"] for r in df.collect()}
    assert {(r["a"], r["b"]) for r in names.entity_pairs(e, "a", "b").collect()} == {("J. C. Lima", "Min. J. C. Lima")}


def test_nicknames_suffixes_and_organs():
    m = names.Matcher([("Beto", "Roberto"), ("Beto", "Alberto"), ("Malu", "Maria Luísa")])
    s = lambda a, b: m.similarity(names.parse(a), names.parse(b)) > 0
    assert s("Beto Ponorrilde", "Roberto Ponorrilde") and s("Beto Ponorrilde", "Alberto Ponorrilde") and not s("Roberto Ponorrilde", "Alberto Ponorrilde")
    assert s("Luís Ponorrilde Jr.", "Luis Ponorrilde Júnior") and not s("Luís Ponorrilde Filho", "Luís Ponorrilde Neto")
    assert s("C. ESP. Ponorrilde Trevalim", "Ponorrilde Trevalim (Câmara Especial)") and not s("Turma Recursal Ponorrilde", "Câmara Especial Ponorrilde")
    assert s("Malu Ponorrilde Trevalim", "Maria Luísa Ponorrilde Trevalim")
    assert s("V. Trab. Recife", "Vara do Trabalho de Recife") and s("TR Ponorrilde Trevalim", "Ponorrilde-Trevalim (Turma Recursal)") and s("Ponorrilde Trevalim - C. Esp.", "Câmara Especial Ponorrilde Trevalim")
    assert s("Silva Carlos José", "José Carlos Silva") and s("José Silva", "José Carlos Almeida Prado Souza Silva") and not s("Carlos Silva", "José Carlos Silva")
    assert s("OlíviaBrinjemira Trevalim", "Olívia Brinjemira Trevalim") and s("D. Ponorrilde Trevalim", "Davi Ponorrilde Trevalim") and s("E. A. Ponorrilde", "Eduardo Artur Ponorrilde")


def test_similarity_is_the_best_assignment():
    from itertools import permutations

    r = random.Random(8)
    for _ in range(200):
        n, m = sorted((r.randrange(1, 5), r.randrange(1, 5)))
        v = [[r.choice([0.0, r.random()]) for _ in range(m)] for _ in range(n)]
        to = names.assignment(v)
        assert len(set(to)) == n and abs(sum(v[i][j] for i, j in enumerate(to)) - max(sum(v[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n))) < 1e-9


def test_nicknames_are_learned_from_surnames_in_common(spark):
    many = [f"{g} Sobrenome{chr(97 + k)} Final{chr(97 + k)}" for k in range(6) for g in ("Inácio", "Naco")] + [f"Inácio Outro{chr(97 + k)} Final" for k in range(9)] + ["Marta Sobrenomea Finala"] + [f"Marta Nome{chr(97 + k)} Final" for k in range(9)]
    n = names.nodes(spark.createDataFrame([(x,) for x in many], "relator string"), "relator")
    assert [tuple(r) for r in names.learned(n).collect()] == [("naco", "inacio")]


def random_names(n, seed):
    r = random.Random(seed)
    syllable = ["ba", "cre", "dol", "fim", "gus", "lan", "mur", "pen", "qui", "ros", "tav", "xil"]
    surname = ["".join(r.choice(syllable) for _ in range(3)) for _ in range(30)]
    given = ["Antônio", "Beatriz", "Carolina", "Davi", "Eduardo", "Fernanda", "Gustavo", "Helena"]
    out = set()
    for _ in range(n):
        g, a, b = r.choice(given), r.choice(surname), r.choice(surname)
        out |= {f"{g} {a} {b}", r.choice([f"{g[0]}. {a} {b}", f"{g} {a[0]}. {b}", f"{b}, {g} {a}", f"{g} {b}"])}
        k = r.randrange(1, len(b) - 1)
        out.add(f"{g} {a} {b[:k]}{b[k + 1] + b[k]}{b[k + 2 :]}")
    return sorted(out)


def test_candidates_against_brute_force_and_hot_buckets(spark):
    from itertools import combinations

    parsed = {names._pack(names.parse(x)) for x in random_names(25, 3)}
    n = spark.createDataFrame([(x,) for x in parsed], "node string")
    m = names.Matcher([])
    uses = {}
    for x in parsed:
        g = x.split("|")[1].split(" ")[0]
        uses[g] = uses.get(g, 0) + 1
    in_use = lambda a, b: min(u := [uses[x.split("|")[1].split(" ")[0]] for x in (a, b)]) >= 3 and min(u) * names.RATIO >= max(u)
    want = {(a, b) for a, b in combinations(sorted(parsed), 2) if m.similarity(names._unpack(a), names._unpack(b), in_use(a, b)) > 0}
    got = {(r["a"], r["b"]) for r in names.links(n, []).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) > 40
    e = names.entities(spark.createDataFrame([(x.split("|")[1],) for x in parsed], "relator string"), spark.createDataFrame([], "apelido string, nome string"))
    assert e.count() == len(parsed)
    hot = {(r["a"], r["b"]) for r in names.links(n, [], hot=4).collect()}  # their members are linked to the fullest of theirs
    assert hot <= got and {x for p in hot for x in p} == {x for p in got for x in p}


def test_links_are_those_of_all_pairs(spark):
    from itertools import combinations

    more = ["V. Trab. Recife", "Vara do Trabalho de Recife", "TR Ponorrilde Trevalim", "Turma Recursal Ponorrilde Trevalim", "OlíviaBrinjemira Trevalim", "Olívia Brinjemira Trevalim", "Malu Ponorrilde Trevalim", "Maria Luísa Ponorrilde Trevalim", "Lulu Ponorrilde", "Luciana Ponorrilde", "Nando Trevalim", "Fernando Trevalim", "J. C. A. Lima", "José Carlos Almeida Lima", "Carlinhos Lima", "Carlos Lima", "Silva Carlos José", "José Carlos Silva", "Davi BabadolCrecre", "Ponorrilde", "Ponorrilda"]
    more += [f"Helena {x} Brinjemira" for x in ("Mur", "Murcia", "Murci", "Murcio", "M.", "Dolfim", "D.")]
    nick = [("Malu", "Maria Luísa"), ("Nando", "Fernando")]
    parsed = {names._pack(n) for x in random_names(25, 5) + more if (n := names.parse(x))}
    uses = {}
    for x in parsed:
        g = x.split("|")[1].split(" ")[0]
        uses[g] = uses.get(g, 0) + 1
    in_use = lambda a, b: min(u := [uses[x.split("|")[1].split(" ")[0]] for x in (a, b)]) >= 3 and min(u) * names.RATIO >= max(u)
    m = names.Matcher(nick)
    want = {(a, b) for a, b in combinations(sorted(parsed), 2) if m.similarity(names._unpack(a), names._unpack(b), in_use(a, b)) > 0}
    n = spark.createDataFrame([(x,) for x in parsed], "node string")
    assert {(r["a"], r["b"]) for r in names.links(n, nick).collect()} == want
    assert {(r["a"], r["b"]) for r in names.links(n, nick, hot=4).collect()} == want


def test_candidates_do_not_grow_with_frequent_parts(spark):
    r = random.Random(2)
    part = lambda: "".join(r.choice("bcdfglmnprstvx") + r.choice("aeiou") for _ in range(5))
    many = sorted({f"Maria {part()} {part()} Silva" for _ in range(400)})
    many += [f"M. {many[0].split()[1]} Silva", many[1].replace("Maria ", "Maira ")]
    d = names.described(spark.createDataFrame([(names._pack(names.parse(x)),) for x in many], "node string"))
    assert 2 <= names.candidates(d, []).count() <= 10  # 79,800 pairs have Maria and Silva in common


def test_bands_reach_the_recall():
    b = names.bands(0.3, 0.97)
    assert 1 - (1 - 0.3**names.ROWS) ** b >= 0.97 > 1 - (1 - 0.3**names.ROWS) ** (b - 1)


# ---- 5


def test_pieces_against_their_definition(spark):
    r = random.Random(1)
    for _ in range(60):
        t = "".join(r.choice(["a", "bc", " ", " ", ". A", "\n", "\n\n", "é", "; ", "x" * 40]) for _ in range(r.randrange(0, 900)))
        limit, over = r.choice([(100, 20), (300, 0), (50, 49)])
        ps = split.spans(t, limit, over)
        assert ps[0][0] == 0 and ps[-1][1] == len(t) and all(b - a <= limit for a, b in ps)
        assert all(ps[i][0] == ps[i - 1][1] - over and ps[i][1] > ps[i - 1][1] for i in range(1, len(ps)))
        assert limit - over == 1 or all(not unicodedata.combining(t[b]) or b - a < limit for a, b in ps[:-1])
    sizes = [0, 5, 6, 7, 20, 21, 22]
    assert all(sizes[b] - sizes[a] <= 15 for a, b in split.spans("abcdef", 15, 2, offsets=sizes))
    df = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (3, "palavra " * 6000, "p"), (3, "palavra " * 6000, "q")], "i long, t string, piece string")
    got = split.split_items(df, "i", "t").dropDuplicates(["i", "piece_no"])
    assert {r["i"] for r in got.collect()} == {2, 3} and got.where("i = 3 AND length(piece) > 3000").count() == 0
    assert got.where("i = 3").agg(F.max("pieces")).first()[0] == got.where("i = 3").count()
    assert split.split_items(df.limit(0), "i", "t").count() == 0


def test_a_boundary_before_a_hard_cut():
    t = "Palavra um. " * 30 + "x" * 5000
    assert split.spans(t, 3000, 200)[0] == (0, 360) and split.spans(t, 3000, 200)[1] == (160, 3160)
    assert split.spans("a" * 5000, 3000, 200) == [(0, 3000), (2800, 5000)]


def test_cuts_prefer_better_boundaries():
    t = "a" * 60 + ". B" + "b" * 20 + "\n\n" + "c" * 10 + " " + "d" * 60
    assert t[: split.spans(t, 100, 10)[0][1]].endswith("\n\n")
    with pytest.raises(ValueError):
        split.spans("x", 10, 10)


# ---- 6


@pytest.fixture(scope="module")
def tools():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    with open(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        return bpe.Encoder(f.read()), lambda s: t.encode(s, add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(tools, spark, small):
    e, want = tools
    r = random.Random(3)
    bits = ["a", "b", " ", "  ", "\n", "'", "s", "ll", "é", "😀", "1", "=", "==", "\t", "The", "ing", " ", " \n", "中", "　", "<|endoftext|>"]
    for _ in range(400):
        s = "".join(r.choice(bits) for _ in range(r.randrange(40)))
        assert e.encode(s) == want(s) and e.count(s) == len(want(s))
    df = spark.read.parquet(f"{small}/documents.parquet")
    for row in bpe.encode_column(df, "doc_id", "text").join(df, "doc_id").collect():
        assert list(row["ids"]) == (want(row["text"]) if row["text"] else [])


def test_appends_and_edits_are_exact(tools):
    e, want = tools
    r = random.Random(4)
    bits = ["a", "b", " ", "  ", "\n", "'", "s", "ll", "re", "é", "1", "=", "The", "ing"]
    for _ in range(300):
        s = "".join(r.choice(bits) for _ in range(r.randrange(40)))
        k = r.randrange(len(s) + 1)
        d = bpe.Document(e, s[:k])
        d.append(s[k:])
        assert d.ids == want(s)
        i = r.randrange(len(s) + 1)
        j = r.randrange(i, len(s) + 1)
        new = "".join(r.choice(bits) for _ in range(r.randrange(5)))
        d.edit(i, j, new)
        assert d.text == s[:i] + new + s[j:] and d.ids == want(d.text)


def test_ids_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a " * 50000, "x")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: len(r["ids"]) for r in bpe.encode_column(df, "doc_id", "text").collect()}
    assert got[1] == got[2] == 0 and got[3] > 50000
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0


# ---- 7


def mixture(spark, rows, table, total=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int, position int")
    m = spark.createDataFrame(table, "fonte string, peso double, max_repeticoes int")
    return mix.Mixture(docs, m, lambda c: F.length(c).cast("bigint"), total)


def test_mixture_shares_repeats_and_positions(spark):
    r = random.Random(2)
    rows = [(i, "x" * r.randrange(1, 40), s, 0, 0) for i, s in enumerate(["a"] * 600 + ["b"] * 300 + ["c"] * 20)]
    rows += [(9001, None, "a", 0, 0), (9002, "", "b", 0, 0), (9003, "xxx", None, 0, 0), (9004, "xxx", "z", 0, 0), (0, "x", "a", 0, 0)]
    m = mixture(spark, rows, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("c", 0.2, 3), ("none", 0.1, 5), (None, 0.5, 1), ("a", None, 2)])
    got = m.ordered().collect()
    pos = [x["position"] for x in got]
    assert pos == sorted(pos) and 0 <= pos[0] and pos[-1] <= m.total
    used = {}
    for x in got:
        used[x["doc_id"]] = used.get(x["doc_id"], 0) + 1
        assert x["n_tokens"] > 0
    src = {i: s for i, _, s, _, _ in rows}
    assert all(n <= {"a": 1, "b": 2, "c": 3}[src[i]] for i, n in used.items())
    rep = {x["fonte"]: x for x in m.report().collect()}
    assert rep["c"]["tokens"] == 3 * rep["c"]["supply_tokens"] and rep["none"]["tokens"] == 0
    assert all(abs(rep[s]["tokens"] - rep[s]["wanted_tokens"]) <= 40 for s in rep)
    assert abs(sum(x["actual_share"] for x in rep.values()) - 1) < 1e-9
    # lighter sources come later
    mean = lambda s: sum(x["position"] for x in got if x["source"] == s) / sum(x["source"] == s for x in got)
    assert mean("a") < mean("b") < mean("c")


def test_a_schedule_of_the_caller(spark):
    rows = [(i, "x" * 5, "ab"[i % 2], 0, 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int, position int")
    m = mix.Mixture(docs, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "fonte string, peso double, max_repeticoes int"), lambda c: F.length(c).cast("bigint"), schedule={"a": 0.8, "b": -0.8})
    mean = {r["source"]: r["p"] for r in m.placed().groupBy("source").agg(F.avg("position").alias("p")).collect()}
    assert mean["b"] < 0.45 * m.total < 0.55 * m.total < mean["a"]


def test_allotment_and_demand_inverse(spark):
    got = mix.allot({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, 100)
    assert got == {"a": 80.0, "b": 20.0}
    a, q, total = 0.4, 30.0, 100.0
    for u in (0.0, 0.2, 0.9, 1.0):
        p = spark.range(1).select(mix.position(F.lit(u * q), F.lit(q), F.lit(a), total).alias("p")).first()["p"] / total
        assert abs(p + a * (p * p - p) - u) < 1e-9
    m = mixture(spark, [], [("a", 1.0, 1)])
    assert m.ordered().count() == 0 and m.report().first()["tokens"] == 0


# ---- 8


def test_segments_are_the_maximal_ones():
    def brute(x, lo=0, hi=None):  # the best segment, then those left and right of it
        hi = len(x) if hi is None else hi
        best = max(((round(sum(x[i:j]), 9), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        return brute(x, lo, best[3]) + [(best[3], best[4])] + brute(x, best[4], hi)

    r = random.Random(6)
    for _ in range(150):
        x = [r.choice([-3, -2, -1.5, 1.1, 2.3, 0.7]) + r.random() / 97 for _ in range(r.randrange(14))]
        assert [(a, b) for _, a, b in abuse.segments(x)] == brute(x)


def test_disguises_read_alike():
    plain = abuse.tokens("seu imbecil")
    for t in ("seu 1mb3c1l", "seu i.m.b.e.c.i.l", "seu i m b e c i l", "SEU IMBECIIIIL", "seu imbecíl", "seu imb​ecil", "seu іmbесіl"):
        assert [x for x in abuse.tokens(t) if x.isalpha()] == [x for x in plain if x.isalpha()]


def labelled_rows(n, seed):
    r = random.Random(seed)
    calm = ["o contrato foi assinado pelas partes", "a perícia confirmou o dano ao imóvel", "o burro de carga empacou na ladeira", "a vizinha guarda a chave do portão", "requer a citação do réu"]
    bad = ["seu cabeça de bagre inútil", "essa laia devia sumir do mapa", "fecha a matraca criatura asquerosa"]  # known from the labels alone
    out = []
    for i in range(n):
        b = i % 4 == 0
        s = [r.choice(calm) for _ in range(6)] + ([r.choice(bad)] if b else [])
        r.shuffle(s)
        out.append((i, ". ".join(s), b))
    return out


def test_scores_on_held_out_documents(spark):
    train, test = labelled_rows(240, 1), labelled_rows(80, 2)
    docs = spark.createDataFrame([(i, t, "f", 0) for i, t, _ in train] + [(1000 + i, t, None, 0) for i, t, _ in test] + [(5000, None, "f", 0), (5001, " ", "f", 0)], "doc_id long, text string, source string, score int")
    labels = spark.createDataFrame([(i, "ofensa" if b else "nenhum", "x", i) for i, _, b in train] * 2 + [(None, "ofensa", "x", 1), (1, None, "x", 1)], "doc_id long, categoria string, anotador string, rotulado_em int")
    s = abuse.score_documents(docs, labels, ["source"])
    got = {r["doc_id"]: r["passages"] > 0 for r in s.collect()}
    right = sum(got[1000 + i] == b for i, _, b in test)
    assert right >= 76 and not got[5000] and not got[5001]
    rate = {r["source"]: r["documents"] for r in abuse.rates(s).collect()}
    assert rate == {"f": 242, None: 80}
    assert abuse.score_documents(docs.limit(0), labels).count() == 0
    assert abuse.score_documents(docs.limit(3), labels.limit(0)).count() == 3
    assert abuse.labelled(docs, labels, most=50).count() == 50 and 0 < abuse.labelled(docs, labels, chars=2000).count() < 20
