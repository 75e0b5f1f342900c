"""Small fixtures of the training-data operators: brute force, round trips, nulls, empty and repeated rows."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vocata.llm import canon, chunk, cooccur, crf, langid, mix, neardup, pack, pii, pii_table, queries


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# splitting


@pytest.mark.parametrize("text", ["x" * 97, "a b " * 40, "Line one.\nLine two is here. And more!\n\nSECTION\n" * 6, "é🔹 " * 50, ""])
def test_cut_points_round_trip(text):
    parts = chunk.cut_points(text, 30, 7)
    assert all(b - a <= 30 for a, b, _ in parts)
    assert all(p[1] - q[0] == 7 for p, q in itertools.pairwise(parts))
    assert "".join(text[a + (7 if i else 0) : b] for i, (a, b, _) in enumerate(parts)) == text


def test_split_oversized_frame(spark):
    df = spark.createDataFrame([("a", "w " * 40, 1), ("a", "w " * 40, 2), ("b", "short", 1), ("c", None, 1), ("d", "", 1), (None, "q" * 70, 1)], "k string, t string, piece int")
    got = chunk.split_oversized(df, ["k"], "t", 50, 10)
    assert sorted((r["k"] or "-", r["n_pieces"]) for r in got.filter("piece_no = 0").collect()) == [("-", 2), ("a", 2), ("b", 1), ("d", 1)]
    assert chunk.split_oversized(df.limit(0), ["k"], "t", 50, 10).count() == 0
    with pytest.raises(ValueError):
        chunk.cut_points("abc", 5, 5)


# pairs


def test_cooccurrence_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "HELD", 10)
    rng = random.Random(3)
    data = [(f"r{i}", rng.sample([" A ", "b", "C", "d", "e", "B"], rng.randint(0, 5)), "1") for i in range(60)]
    data += [("r0", ["z"], "0"), ("r1", None, "2"), ("r2", [None, " ", "b"], "2"), (None, ["a", "b"], "1"), data[3]]
    b = cooccur.latest_baskets(spark.createDataFrame(data, "id string, s array<string>, v string"), "id", "s", "v")
    baskets = {r["record"]: set(r["items"]) for r in b.collect()}
    assert len(baskets) == 60 and baskets["r1"] == set() and baskets["r2"] == {"b"}
    want = {}
    for x in baskets.values():
        for p in itertools.combinations(sorted(x), 2):
            want[p] = want.get(p, 0) + 1
    got = cooccur.cooccurrence(b).collect()
    assert {(r["item_a"], r["item_b"]): r["n_ab"] for r in got} == want
    assert all(r["n_a"] == sum(r["item_a"] in x for x in baskets.values()) and r["n_records"] == 60 and r["llr"] >= 0 for r in got)
    assert cooccur.cooccurrence(b.limit(0)).count() == 0


# canonical names


def test_map_to_canonical(spark):
    names = spark.createDataFrame([("Meter Consent Forecasting", "mcf"), ("METER CONSENT FORECASTING", "mcf"), ("Anvilbase", "anv"), ("Meter Drift Mapping", "mdm"), ("Freight & Anomaly", "fam"), (None, "x")], "n string, t string")
    e = canon.reference_entries(names, "n", "t")
    typed = ["meter consent forcasting", "Forecasting, Meter Consent", "MeterConsentForecasting", "advanced Anvi1base", "Anvil base", "Mеter Drift Mapping", "Meter Drift Mapp.", "Freight & anomly", "garden work", "Meter", "", None, "???", "Anvilbase", "Anvilbase"]
    got = dict((r["value"], r["target"]) for r in canon.map_to_canonical(spark.createDataFrame([(v,) for v in typed], "v string"), "v", e).collect())
    assert got == {
        "meter consent forcasting": "mcf", "Forecasting, Meter Consent": "mcf", "MeterConsentForecasting": "mcf", "advanced Anvi1base": "anv", "Anvil base": "anv", "Mеter Drift Mapping": "mdm",
        "Meter Drift Mapp.": "mdm", "Freight & anomly": "fam", "garden work": None, "Meter": None, "": None, "???": None, "Anvilbase": "anv",
    }
    assert canon.map_to_canonical(spark.createDataFrame([("x",)], "v string"), "v", e.limit(0)).first()["target"] is None


def test_edit_distance_brute_force():
    def slow(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if i * j == 0}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(4)
    words = ["", *("".join(rng.choices("abcé", k=rng.randrange(8))) for _ in range(200))]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(500)]
    assert list(canon.edit_distance(*zip(*pairs))) == [slow(a, b) for a, b in pairs]


def test_swap_and_another_edit(spark):
    words = ["partition", "variance", "monitoring", "forecasting", "granularity", "seasonality"]
    cases = [("patritio", "partition"), ("vraianc", "variance"), ("mointoribg", "monitoring"), ("frecatsing", "forecasting"), ("ranulraity", "granularity"), ("easonlaity", "seasonality")]
    for w in words:  # every swap with every deletion, and every two swaps
        for i in range(len(w) - 1):
            swapped = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
            cases += [(swapped[:j] + swapped[j + 1 :], w) for j in range(len(w))]
            cases += [(swapped[:j] + swapped[j + 1] + swapped[j] + swapped[j + 2 :], w) for j in range(i + 2, len(w) - 1)]
    typed = spark.createDataFrame([(t, False) for t in {t for t, _ in cases}], "token string, dotted boolean")
    got = {(r["token"], r["vtoken"]): r["sim"] for r in canon.repair_tokens(typed, spark.createDataFrame([(w,) for w in words], "vtoken string")).collect()}
    assert [c for c in cases if got.get(c, 0) < 1 - 2 / len(c[1]) - 1e-9] == []


# near duplicates


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        base = [rng.choice(vocab) for _ in range(60)]
        out.append((f"a{i}", " ".join(base)))
        if i % 2:
            edited = list(base)
            for _ in range(rng.randint(1, 5)):
                edited[rng.randrange(60)] = rng.choice(vocab)
            out.append((f"b{i}", " ".join(edited)))
    return out


def jaccard(a, b, k):
    sh = lambda t: {tuple(w[i : i + k]) for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - k + 1)}
    x, y = sh(a), sh(b)
    return len(x & y) / max(1, len(x | y))


@pytest.mark.parametrize("hot", [200, 2])
def test_near_duplicates_brute_force(spark, hot):
    docs = corpus() + [("n1", None), (None, "x y z"), ("s1", "only two"), ("s2", "only two"), ("e", ""), ("c1", corpus()[0][1]), ("c2", corpus()[0][1]), ("a0", corpus()[0][1])]
    texts = {k: t for k, t in docs if k and t}
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if jaccard(texts[a], texts[b], 3) >= 0.7}
    members, links = neardup.near_duplicates(spark.createDataFrame(docs, "id string, t string"), "id", "t", 3, 0.7, hot=hot)
    assert set(rows(neardup.linked_items(members, links))) == want
    few = set(rows(neardup.linked_items(members, links, full=1)))
    assert few <= want and {x for p in want for x in p} == {x for p in few for x in p}
    g = {r["item"]: r["group_id"] for r in neardup.groups(members.select("item", "cls"), links).collect()}
    assert all(g[a] == g[b] for a, b in want) and g["s1"] == g["s2"] and len({g["a0"], g["a2"]}) == 2


@pytest.mark.parametrize("chunk", [(), (3,)])
def test_one_shared_block_is_enough_at_any_size(spark, chunk):
    # all 12 share block 1 and no other; 99 has another sketch, 7 comes twice, 50 and 51 share a small block
    far, near = (-1, -1), (5, 9)
    fp = [(c, *near, [1, 1000 + c]) for c in (*range(11), 7)] + [(99, *far, [1, 1099]), (50, *near, [2, 1050]), (51, *near, [2, 1051])]
    got = neardup.candidates(spark.createDataFrame(fp, "cls long, hi long, lo long, blocks array<long>"), 3, *chunk)
    assert rows(got) == sorted([*itertools.combinations(range(11), 2), (50, 51)], key=repr)


def test_near_duplicates_empty(spark):
    members, links = neardup.near_duplicates(spark.createDataFrame([], "id string, t string"), "id", "t")
    assert neardup.linked_items(members, links).count() == 0


def test_groups_of_a_chain(spark):
    members = spark.range(1, 41).select(F.concat(F.lit("i"), "id").alias("item"), F.col("id").alias("cls"))
    links = spark.range(1, 40).filter("id != 20").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("similarity"))
    got = {r["item"]: r["group_id"] for r in neardup.groups(members, links).collect()}
    assert {got[f"i{i}"] for i in range(1, 21)} == {"i1"} and {got[f"i{i}"] for i in range(21, 41)} == {"i21"}


# packing and mixing


def test_sum_of_squares():
    sizes = np.sort(np.random.default_rng(0).integers(1, 50, 500))[::-1]
    fill = np.bincount(pack.sum_of_squares(sizes, 100), sizes)
    assert fill.max() <= 100 and fill.sum() == sizes.sum() and len(fill) <= -(-sizes.sum() // 100) * 1.02 + 1


def test_pack(spark):
    df = spark.createDataFrame([(i, 7 + i % 40) for i in range(300)] + [(300, 0), (301, None), (302, 100), (303, 250), (None, 5), (5, 12)], "item int, size int")
    got = pack.pack(df, "item", "size", 100, 5).collect()
    assert {r["item"] for r in got} == set(range(304)) and sum(r["size"] for r in got if r["item"] == 303) == 250
    fill = {}
    for r in got:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["size"]
    assert max(fill.values()) <= 100 and all(fill[r["container_id"]] == r["container_fill"] for r in got)
    assert pack.pack(df.limit(0), "item", "size", 100).count() == 0


def test_mix(spark):
    sized = spark.createDataFrame([(i, "a" if i % 10 else "b", 50 + i % 30) for i in range(4000)] + [(9001, "c", 10), (9002, "d", 0)], "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("e", 0.2, 2), ("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mix.mix(sized, targets, block_tokens=200)
    s = {r["source"]: r for r in shares.collect()}
    assert abs(s["a"]["actual_share"] - 0.625) < 0.01 and s["e"]["note"] == "no texts" and s["c"]["note"] == "no target"
    got = chosen.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and all(r["repeats"] <= (1 if r["source"] == "a" else 3) for r in got)
    most = min(s["a"]["available_tokens"] / 0.625, 3 * s["b"]["available_tokens"] / 0.375)
    assert 0.97 * most < sum(r["tokens"] for r in s.values()) < 1.03 * most
    chosen, shares = mix.mix(sized.limit(0), targets)
    assert chosen.count() == 0 and shares.count() == 3


# random fields


def test_forward_backward_and_viterbi_brute_force():
    rng = np.random.default_rng(1)
    e, trans, first, last = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    lengths = np.array([4, 2])
    post, _, norm = crf.forward_backward(e, lengths, trans, first, last)
    path = crf.viterbi(e, lengths, trans, first, last)
    total = 0.0
    for j, n in enumerate(lengths):
        scores = {}
        for y in itertools.product(range(3), repeat=int(n)):
            scores[y] = first[y[0]] + last[y[-1]] + sum(e[t, j, y[t]] for t in range(n)) + sum(trans[a, b] for a, b in itertools.pairwise(y))
        z = np.log(sum(np.exp(list(scores.values()))))
        total += z
        assert tuple(path[:n, j]) == max(scores, key=scores.get)
        for t in range(n):
            assert np.allclose(post[t, j], [sum(np.exp(s - z) for y, s in scores.items() if y[t] == k) for k in range(3)])
    assert np.isclose(norm, total)


NAMES = [f"{a} {b}" for a in ("Oluchi", "Renske", "Gisela", "Perrin", "Delphine", "Tamsin") for b in ("Quistorpe", "Sandovalli", "Nightsdale", "Mbekwari", "Verhoevel", "Harrowgate-Lim")]


COLUMNS = (NAMES, ["Dunmarrow, Estria", "Port-Ember, Lowfen", "Verrowick, Veranto"], ["Crop Backfill Automation", "Yondergrid"])


@pytest.fixture(scope="module")
def pii_model():
    return pii.train(*COLUMNS, docs=1500, held=False)


def test_pii_held_out(spark, pii_model):
    """Patterns, streets, hosts, labels and number formats that training never met."""
    table = pii_table.labelled_lines(*COLUMNS, 250, 99, True, plain=True)
    docs = [(str(i), "".join(t for t, _ in runs)) for i, runs in enumerate(table)]
    want = {(str(i), k, t) for i, runs in enumerate(table) for t, k in runs if k}
    found = pii.find_pii(spark.createDataFrame([*docs, ("n", None), ("e", ""), (None, "no words 12")], "id string, spans string"), ["id"], "spans", pii_model)
    got = set(rows(pii.found_values(found, ["id"])))
    for kind, least in {"email": 0.75, "phone": 0.85, "id_number": 0.6, "address": 0.6, "name": 0.7}.items():
        g, w = ({x for x in y if x[1] == kind} for y in (got, want))
        assert 2 * len(g & w) / (len(g) + len(w)) > least, kind
    clean = {r["id"]: r["scrubbed_text"] for r in pii.scrubbed(found, ["id"]).collect()}
    assert clean["e"] == "" and "n" not in clean and sum("[EMAIL]" in c for c in clean.values() if c) > 10


def test_pii_new_texts_of_met_patterns(pii_model):
    table = pii_table.labelled_lines(*COLUMNS, 250, 98, False, plain=True)
    docs = ["".join(t for t, _ in runs) for runs in table]
    want = {(i, k, t) for i, runs in enumerate(table) for t, k in runs if k}
    got = {(i, k, docs[i][a:b]) for i, spans in enumerate(pii.Finder(pii_model).spans(docs)) for a, b, k in spans}
    assert 2 * len(got & want) / (len(got) + len(want)) > 0.9


def test_training_patterns_stand_in_no_test_text():
    texts = "\n".join(t.lower() for f in ("resume_document", "raw_jd") for t in pd.read_parquet(f"/root/testdata/sf0.1/{f}.parquet")["raw_text"].dropna())
    parts = [x.lower() for g in (pii_table.PERSONAL, pii_table.NEUTRAL) for kind in pii_table.patterns(g) for p in kind for x in re.split(r"\{\w\}|\^", p)]
    assert [x for x in {x for x in parts if len(x) >= 12} if x in texts] == []


def test_pii_skipping_changes_nothing(pii_model):
    part, full = pii.Finder(pii_model), pii.Finder(pii_model)
    full.live = lambda e, inner: inner
    docs = ["".join(t for t, _ in runs) for runs in pii_table.labelled_lines(NAMES, [], [], docs=40, seed=5)]
    assert part.spans(docs) == full.spans(docs)


SENTENCES = {
    "en": ["We expect you to question the report before anyone else does.", "There is budget for training and the team will help you.", "Travel to the other sites is needed every week."],
    "fr": ["Nous cherchons une personne qui sait expliquer le rapport sans jargon.", "Elle a quitté l'entreprise pendant l'audit pour reprendre l'étude.", "Merci de joindre une lettre qui décrit votre travail."],
    "de": ["Wir suchen jemanden, der die Absatzplanung auch ohne Fachbegriffe erklären kann.", "Die Arbeit ist teilweise von zu Hause aus möglich.", "Ihre Bewerbung wird innerhalb von wenigen Tagen gelesen."],
    "es": ["Buscamos a alguien que sepa explicar la migración sin tecnicismos.", "Su solicitud será leída por el comité de empresa.", "Ofrecemos un horario flexible y la posibilidad de trabajar desde casa."],
    "pt": ["Procuramos alguém que saiba explicar a migração sem termos técnicos.", "A sua candidatura será lida pela direção financeira.", "Oferecemos horário flexível e a possibilidade de trabalhar em casa."],
    "nl": ["Je bent verantwoordelijk voor de jaarlijkse enquête.", "Elke maandag bespreken we met de partners hoe het ervoor staat.", "We zoeken iemand die het overzicht zonder vaktaal kan uitleggen."],
}


def test_language(spark):
    rng = random.Random(2)
    data = []
    for lang, s in SENTENCES.items():
        for _ in range(30):
            data.append((" ".join(rng.sample(s, 2)), lang if rng.random() > 0.05 else "en"))
    model = langid.train(tuple(data), epochs=8)
    mixed = SENTENCES["en"][0] + " " + SENTENCES["fr"][1] + "\n- " + SENTENCES["fr"][2] + " " + SENTENCES["en"][1]
    df = spark.createDataFrame([(1, mixed, "en"), (1, mixed, "en"), (2, SENTENCES["de"][0], "fr"), (3, SENTENCES["nl"][2], " NL-be"), (4, "12 34 --", "en"), (5, "", None), (6, None, "en"), (7, SENTENCES["es"][1], "Spanish")], "runs long, t string, l string")
    got = {r["doc_id"]: r for r in langid.tag(df, "runs", "t", "l", model).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 7}
    assert [(r["start"], r["lang"]) for r in got[1]["runs"]] == [(0, "en"), (mixed.index("Elle"), "fr"), (mixed.index("There"), "en")]
    assert (got[2]["lang"], got[2]["label_lang"], got[3]["lang"], got[3]["label_lang"], got[7]["label_lang"]) == ("de", "fr", "nl", "nl", "es")
    assert got[4]["lang"] is None and got[5]["runs"] == [] and got[1]["confidence"] > 0.5


def test_subpackage_queries_have_sql_for_known_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    from oracle import compare

    sf = "sf0.01" if name == "p8_check" else "sf0.001"  # too few documents to meet any share
    assert compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], sf) == ""
