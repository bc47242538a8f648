"""Name links and components against plain versions."""

import random

from pyspark.sql import functions as F

from docketlake.llm import components, names

REGISTER = [
    (1, "Drollurfa Communications B.V.", "organisation", None),
    (2, "Damshuwe Networks S.A.", "organisation", ["Glundsiol"]),
    (3, "Damshuwe Systems", "organisation", None),
    (4, "Jeaviom Advanced Research Institute", "organisation", None),
    (5, "Sistgith & Glunkuth Technologies", "organisation", None),
    (6, "Maristel Dramsend", "delegate", None),
    (7, "Halvora Flembreath", "delegate", None),
    (8, "Bremzeaflum Technologies", "organisation", None),
    (9, "Glestsha Technologies Inc.", "organisation", None),
    (10, "Orbital Networks", "organisation", None),
    (11, "Zenleam Networks", "organisation", None),
    (12, "Kestben Research Ltd.", "organisation", None),
    (13, "Juvedeal Research", "organisation", None),
    *((20 + i, f"{n} {t}", "organisation", None) for i, (n, t) in enumerate((n, t) for n, t in zip(("Kwarsen", "Lomitra", "Wexhal", "Pundor", "Tirvaq", "Yolbeck"), ("Communications", "Systems") * 3))),
]
VARIANTS = {
    "drollurfa communications": 1, "Communications Drollurfa, B.V. (?)": 1, "DrollurfaCommunications": 1, "Drollurfa-Comms BV": 1, "Drolurfa Communcations": 1, "Dollurfa": 1,
    "Damshuwe": None, "Damshuwe SA": 2, "glundsiol": 2, "Damshuwe Netwroks": 2, "JARI": 4, "J.A.R.I.": 4, "Jeaviom Adv. Res. Inst.": 4, "Sistgith and Glunkuth Techs": 5,
    "Dramsend, Maristel": 6, "M. Dramsend": 6, "Mar Dramsend": 6, "H.Flembreath (chair)": 7, "Bremzeaflum": 8, "Kestben Ltd": 12,
    "editor": None, "(Rapporteur)": None, "Networks": None, "Quite Unknown Research": None, "Nokia": None,
}


def register(spark, rows=REGISTER):
    return spark.createDataFrame(rows, "entry_id bigint, name string, kind string, aliases array<string>")


def test_variants(spark):
    df = spark.createDataFrame([(v,) for v in [*VARIANTS, *VARIANTS, None, "", "  "]], "v string").withColumn("entry_id", F.lit(0))
    got = {r.value: r.entry_id for r in names.link_names(df, "v", register(spark)).collect()}
    assert got == {v: e for v, e in VARIANTS.items() if e}


def test_register_in_several_tries(spark):
    df = spark.createDataFrame([("drollurfa communicatons",), ("Dramsend, Maristel",), ("editor",)], "v string")
    got = {r.value: r.entry_id for r in names.link_names(df, "v", register(spark), trie_names=4).collect()}
    assert got == {"drollurfa communicatons": 1, "Dramsend, Maristel": 6}
    assert names.link_names(df, "v", register(spark, [])).count() == 0


def test_several_tries_link_like_one(spark):
    df = spark.createDataFrame([(v,) for v in VARIANTS], "v string")
    for tries in (1, 4, 11):
        got = {r.value: r.entry_id for r in names.link_names(df, "v", register(spark), trie_names=tries).collect()}
        assert got == {v: e for v, e in VARIANTS.items() if e}


def distance(a, b):
    """Edits, a swap of neighbours counts one."""
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_search_by_brute_force():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 8))) for _ in range(300)})
    trie = names.Trie(words)
    for bound in (0, 1, 2):
        for _ in range(60):
            w = "".join(rng.choices("abcd", k=rng.randint(0, 8)))
            assert trie.near(w, bound) == {x: distance(w, x) for x in words if distance(w, x) <= bound}


def plain_components(edges):
    group = {}
    for a, b in edges:
        if a and b and a != b:
            merged = group.get(a, {a}) | group.get(b, {b})
            for x in merged:
                group[x] = merged
    return {x: min(g) for x, g in group.items()}


def test_components_at_every_bound(spark):
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(120):03}", f"n{rng.randrange(120):03}") for _ in range(90)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [(None, "x"), ("y", None), ("z", "z"), ("hub", None)]
    edges += [("hub", f"h{i}") for i in range(80)] + edges[:5] + [(b, a) for a, b in edges[:5]]
    df = spark.createDataFrame(edges, "a string, b string").withColumn("root", F.lit(1)).repartition(5)
    for bound in (1_000_000, 50, 1):
        got = {r.node: r.group_id for r in components.connected_components(df, "a", "b", rows_per_task=bound).collect()}
        assert got == plain_components(edges)
    assert components.connected_components(df.where("false"), "a", "b").count() == 0


def test_many_nodes_merge_through_bounded_partitions(spark):
    rng = random.Random(9)
    name = lambda i: f"S2-{2300000 + i}"
    chain = [(name(i + 1), name(i)) for i in range(700)]
    star = [(name(2000), name(2001 + i)) for i in range(400)]
    loose = [(name(3000 + rng.randrange(500)), name(3000 + rng.randrange(500))) for _ in range(350)]
    edges = [*chain, *star, *loose, *star[:50]]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a string, b string").repartition(3)
    got = {r.node: r.group_id for r in components.connected_components(df, "a", "b", rows_per_task=300).collect()}
    assert got == plain_components(edges)


def test_a_partition_of_many_nodes_gives_out_forests():
    import pandas as pd

    run = components.local_forest(10)
    frames = list(run(iter([pd.DataFrame({"node": [f"b{i}" for i in range(k, k + 8)], "root": [f"a{i}" for i in range(k, k + 8)]}) for k in range(0, 40, 8)])))
    assert len(frames) > 2 and sorted(r for f in frames for r in zip(f["node"], f["root"])) == sorted((f"b{i}", f"a{i}") for i in range(40))


def test_names_of_any_number_of_words(spark):
    long_name = "Glarn Vost Pelmir Quanto Drevik Sumtal Orwin Hesk Talvo Brint"
    reg = register(spark, [(1, long_name, "organisation", None), (2, "Kestben Radio Ltd.", "organisation", None), (3, "Kestben Radio", "organisation", None)])
    reversed_ = " ".join(reversed(long_name.split()))
    df = spark.createDataFrame([(reversed_,), ("Hesk Brint Talvo Orwin Sumtal Drevik Qaunto Pelmir Vost Glarn",), ("Kestben Radio",)], "v string")
    for tries in (1, 2, 20_000):
        got = {r.value: r.entry_id for r in names.link_names(df, "v", reg, trie_names=tries).collect()}
        assert got[reversed_] == 1 and len(got) == 2 and set(got.values()) == {1}


def test_assignment_by_brute_force():
    from itertools import permutations

    rng = random.Random(3)
    for _ in range(300):
        places, rows = rng.randint(1, 6), rng.randint(1, 5)
        options = [sorted((round(rng.uniform(-2, 2), 2), k) for k in rng.sample(range(places), rng.randint(1, places))) for _ in range(rows)]
        best = min((sum(dict((k, c) for c, k in o)[k] for o, k in zip(options, p)) for p in permutations(range(places), rows) if all(k in {x for _, x in o} for o, k in zip(options, p))), default=None) if rows <= places else None
        got = names.assign(options, [1] * rows, [1] * places)
        # two equal rows and two equal places are the same as one of each, twice
        twice = names.assign(options, [2] * rows, [2] * places)
        assert (twice is None) == (got is None) and (got is None or abs(twice - 2 * got) < 1e-9)
        assert (got is None) == (best is None) and (best is None or abs(got - best) < 1e-9)


def test_very_long_names(spark):
    reg = register(spark, [(1, "word " * 3000, "organisation", None), (2, " ".join(f"w{i}x" for i in range(2000)), "organisation", None)])
    values = ["word " * 2999, " ".join(f"w{i}x" for i in reversed(range(2000))), "x" * 20_000]
    got = {r.value: r.entry_id for r in names.link_names(spark.createDataFrame([(v,) for v in values], "v string"), "v", reg).collect()}
    assert got == {values[0]: 1, values[1]: 2}
