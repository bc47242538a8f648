"""Look-alike text, tokens, packing, spans, near duplicates, garbled text against plain versions."""

import os
import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketlake.llm import confusables, mojibake, neardup, packing, spans, tokens


def table(spark, rows, kind="string"):
    return spark.createDataFrame(rows, f"id bigint, t {kind}").withColumn("class", F.lit(1)).withColumn("n", F.lit("x"))


# --- look-alikes


@pytest.mark.parametrize(
    ("written", "form"),
    [
        ("Ѕ２－２６", "S2-26"), ("ﬁne print​", "fine print"), (" a ", "a"), ("é", "é"), ("cосо", "coco"), ("нaгрузка", "нагрузка"),
        ("сосо", "coco"), ("x²₂", "x²₂"), ("5 µs", "5 μs"), ("a–b−c", "a-b-c"), (None, None), ("", ""), ("​ ", ""), ("Ａｂ", "Ab"), ("ё", "ë"),
    ],
)
def test_consistent_form(written, form):
    assert confusables.consistent_form(written) == form


def test_form_is_stable():
    for s in ("нaгрузка", "Τеst", "ο", "ѕсоре"):
        assert confusables.consistent_form(confusables.consistent_form(s)) == confusables.consistent_form(s)


def test_same_look_pairs(spark, rows):
    data = [(1, "scope"), (2, "ѕсоре"), (3, "scope"), (4, "scope "), (4, "scope "), (5, "Scope"), (6, None), (7, ""), (8, "​")]
    assert rows(confusables.same_look_pairs(table(spark, data), "id", "t")) == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8)]
    assert rows(confusables.same_look_pairs(table(spark, []), "id", "t")) == []


def test_line_ends_are_no_part_of_a_form(spark, rows):
    data = [(i, "abc" + end) for i, end in enumerate(["", "\n", "\r\n", "\x85", "\u2028", "\r"])]
    got = table(spark, data).select("id", confusables.look(F.col("t")))
    assert rows(got) == [(i, confusables.consistent_form(t)) for i, t in data] == [(i, "abc") for i, _ in data]
    assert len(rows(confusables.same_look_pairs(table(spark, data), "id", "t"))) == 15


# --- tokens and containers

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = tokens.load_ranks(f.read())
    return tokens.Encoder(ranks), tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs_vocabulary
@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(" \n\t\r ab'sZ9.，é中　\x1c\x85🙂<|>"), max_size=40) | st.text(max_size=60).filter(lambda s: s.isprintable() or True))
def test_ids_equal_another_encoder(reference, text):
    ours, theirs = reference
    text = text.encode("utf-8", "ignore").decode("utf-8", "ignore")
    assert ([i for s in ours.stretches(text) for i in ours[s]] if text else []) == theirs.encode_ordinary(text)


@needs_vocabulary
def test_long_piece_and_round_trip(reference):
    ours, theirs = reference
    text = "".join(random.Random(1).choices(string.ascii_letters, k=30_000))
    got = tokens.merge_piece(text.encode(), ours.ranks)
    assert theirs.decode(got) == text


@needs_vocabulary
def test_ids_of_empty_and_null(spark):
    got = tokens.encode_texts(table(spark, [(1, None), (2, ""), (3, "a <|endoftext|>")]), "id", "t").orderBy("doc_id").collect()
    assert [len(r.ids) for r in got][:2] == [0, 0] and 50256 not in got[2].ids
    sizes = tokens.count_tokens(table(spark, [(1, None), (3, "a <|endoftext|>")]), "id", "t").orderBy("doc_id").collect()
    assert [r.tokens for r in sizes] == [0, len(got[2].ids)]
    assert tokens.encode_texts(table(spark, []), "id", "t").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_best_two_fit_keeps_every_item(sizes):
    at = packing.best_two_fit(sizes, 50)
    fill: dict[int, int] = {}
    for s, b in zip(sizes, at, strict=True):
        fill[b] = fill.get(b, 0) + s
    assert len(at) == len(sizes) and all(v <= 50 for v in fill.values())
    if sum(sizes):
        assert len(fill) <= 1 + sum(sizes) // 25  # two containers that are less than half full would be one


def test_best_two_fit_takes_the_better_pair():
    assert packing.best_two_fit([6, 3, 2, 2], 10) == [0, 1, 0, 0]


def test_pack_splits_only_what_is_too_long(spark):
    items = spark.createDataFrame([(1, 25), (2, 0), (3, None), (4, 10), (5, 4), (5, 4), (6, 6)], "id bigint, size int")
    got = packing.pack(items, "id", "size", capacity=10, shard_items=100).collect()
    assert sorted((r.item_id, r.piece, r.start, r.size) for r in got if r.item_id == 1) == [(1, 0, 0, 10), (1, 1, 10, 10), (1, 2, 20, 5)]
    assert len(got) == 9 and len({r.container for r in got}) == 5
    assert packing.pack(items.where("false"), "id", "size").count() == 0
    many = spark.range(500).select("id", (F.col("id") % 10 + 1).alias("size"))
    assert packing.pack(many, "id", "size", capacity=10, shard_items=50).groupBy("container").agg(F.sum("size").alias("s")).where("s > 10").count() == 0


# --- spans


def brute_shared(data, least):
    own = {}
    for i, t in data:
        if t:
            own.setdefault(i, t)
    out = {}
    for i, t in own.items():
        hit = [any(t[k : k + least] in u for j, u in own.items() if j != i) for k in range(len(t) - least + 1)]
        covered = {p for k, h in enumerate(hit) if h for p in range(k, k + least)}
        if covered:
            out[i] = len(covered)
    return out


def test_shared_spans_by_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcde é🙂", k=n))
    shared = [word(n) for n in (119, 120, 121, 160, 400)]
    data = [(i, word(rng.randint(0, 90)) + rng.choice(shared)[rng.randint(0, 3) :] + word(rng.randint(0, 90))) for i in range(40)]
    data += [(50, shared[4]), (51, shared[4]), (51, shared[4]), (52, None), (53, ""), (54, "x" * 119), (55, "y" * 500), (56, "z" * 150), (57, "z" * 130)]
    got = {r.record_id: r.shared_chars for r in spans.shared_spans(table(spark, data), "id", "t").collect()}
    want = brute_shared(data, 120)
    assert got == want
    # an anchor with many contexts is counted instead of compared: the same result
    counted = {r.record_id: r.shared_chars for r in spans.shared_spans(table(spark, data), "id", "t", contexts=1).collect()}
    assert counted == want
    longer = {r.record_id: r.shared_chars for r in spans.shared_spans(table(spark, data), "id", "t", 150, contexts=3).collect()}
    assert longer == brute_shared(data, 150)
    assert spans.shared_spans(table(spark, []), "id", "t").count() == 0


# --- near duplicates


def brute_near(data):
    sets = {i: neardup.words(t) for i, t in data}
    ids = sorted(i for i, s in sets.items() if s)
    return [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])]


def test_near_duplicates_by_brute_force(spark, rows):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.sample(vocabulary, rng.randint(3, 40)) for _ in range(25)]
    data = []
    for n in range(150):
        ws = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(ws) // 5))):
            ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        rng.shuffle(ws)
        data.append((n, " ".join(ws)))
    data += [(200, None), (201, ""), (202, "... !"), (203, "one"), (204, "ONE."), (204, "ONE."), (205, "оne")]
    got = rows(neardup.near_duplicates(table(spark, data), "id", "t"))
    assert got == sorted(brute_near(data), key=repr) and {(203, 204), (203, 205), (204, 205)} <= set(got)
    assert rows(neardup.near_duplicates(table(spark, data), "id", "t", heavy=5)) == got
    assert neardup.near_duplicates(table(spark, []), "id", "t").count() == 0


def test_rare_edits_hide_no_near_duplicate(spark, rows):
    common = [f"c{i}" for i in range(400)]
    data, want = [], []
    for n in range(0, 60, 2):  # 25 words that occur nowhere else, or only in two records
        base = random.Random(n).sample(common, 60)
        new = [f"new{n}x{i}" for i in range(25)]
        data += [(n, " ".join(base)), (n + 1, " ".join(base + new)), (1000 + n, " ".join(new))]
        want.append((n, n + 1))
    for n in range(60, 120, 2):  # 15 rare words on each side
        base = random.Random(n).sample(common, 75)
        data += [(n + k, " ".join(base + [f"new{n + k}x{i}" for i in range(15)])) for k in (0, 1)]
        want.append((n, n + 1))
    assert rows(neardup.near_duplicates(table(spark, data), "id", "t")) == sorted(want, key=repr) == sorted(brute_near(data), key=repr)


# --- garbled text

CLEAN = ["L’étape générale – “déjà” vérifiée à Zürnau, 5 µs ≥ 4 °C", "Größe der Überwachung hängt ab", "Вопрос передаёт область сервера", "建议在第用户面节中用计费记录替换会话。", "SÃO PAULO, ÂNGULO"]


@pytest.fixture(scope="module")
def corpus():
    wrong = [
        (1000, CLEAN[0].encode().decode("latin-1")),
        (1001, CLEAN[0].encode().decode("cp1251", "replace")),
        (1002, CLEAN[1].encode().decode("mac_roman")),
        (1003, CLEAN[1].encode().decode("cp437").encode().decode("latin-1")),
        (1004, CLEAN[2].encode().decode("latin-1")),
        (1005, CLEAN[2].encode("koi8_r").decode("cp1251")),
        (1006, CLEAN[3].encode("gb2312").decode("latin-1")),
        (1007, CLEAN[0].encode("cp1252", "ignore").decode("utf-8", "replace")),
        (1008, "".join(c for c in CLEAN[1].encode().decode("latin-1") if not 0x80 <= ord(c) < 0xA0)),
    ]
    return [(i, CLEAN[i % 5]) for i in range(300)], wrong


def test_garbled_documents_are_found(spark, corpus):
    clean, wrong = corpus
    df = table(spark, clean + wrong + wrong[:2] + [(2000, None), (2001, ""), (2002, "plain\x85next")])
    got = {r.doc_id for r in mojibake.garbled_places(df, "id", "t").select("doc_id").distinct().collect()}
    assert got == {i for i, _ in wrong}
    assert mojibake.garbled_places(table(spark, []), "id", "t").count() == 0


def test_garbled_documents_are_restored(spark, corpus, tmp_path):
    clean, wrong = corpus
    spark.createDataFrame(clean + wrong, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.restored, r.unrestored) for r in mojibake.p10_restored(spark, str(tmp_path)).collect()}
    for doc, text in ((1000, CLEAN[0]), (1002, CLEAN[1]), (1003, CLEAN[1]), (1004, CLEAN[2]), (1005, CLEAN[2]), (1006, CLEAN[3]), (1008, CLEAN[1])):
        assert got[doc] == (text, 0)


@pytest.mark.parametrize("garbled", ["prüfen übertragen Gerätegruppe Zürnau".encode().decode("latin-1"), "Вопрос передаёт область сервера".encode("koi8_r").decode("cp1251")])
def test_copies_of_a_garbled_text_are_found(spark, garbled):
    sound = [(i, f"{CLEAN[i % 5]} – prüfen wir die Übertragung, übertragen Gerätegruppe {i} für Zürnau") for i in range(200)]
    copies = [(1000 + i, garbled) for i in range(100)]
    got = {(r.doc_id, r.word) for r in mojibake.garbled_places(table(spark, sound + copies), "id", "t").collect()}
    assert got == {(i, w) for i, _ in copies for w in garbled.split(" ")}


def test_long_words_with_lost_bytes_are_restored(spark):
    whole = ["безопасности", "передаваемых"]
    lost = ["".join(c for c in w.encode().decode("latin-1") if not "\x80" <= c < "\xa0") for w in whole]
    lost += ["безопа�ности", "�ередаваемы�"]
    df = table(spark, [(i, f"{' '.join(whole)} {i} на уровне") for i in range(50)] + [(100 + i, w) for i, w in enumerate(lost)])
    got = {r.doc_id: r.fixed for r in mojibake.garbled_places(df, "id", "t").collect()}
    assert got == {100 + i: w for i, w in enumerate(whole * 2)}


def test_fits_lost_bytes():
    assert mojibake.wildcards("operatorâs", "operator’s") == 2 * mojibake.LOST and mojibake.wildcards("GrÃ¶Ãe".replace("Ã¶", "ö"), "Größe") is not None
    assert mojibake.wildcards("operatorâs", "operatorés") is None and mojibake.wildcards("l��l", "l’él") is not None
    assert mojibake.wildcards("запроÑ�", "запрос") == mojibake.WILDCARD and mojibake.wildcards("Ñ" * 5000, "с" * 5000) == 5000 * mojibake.LOST


WORDS = {
    "ru": "сеть структура узел протокол передача данных абонент услуга решение предложение соединение качество маршрут сервер сигнал канал уровень запрос ответ".split(),
    "de": "Übertragung Geräte prüfen Lösung Änderung für über größer Schlüssel Fähigkeit Qualität Vermittlungsstelle".split(),
    "fr": "réseau qualité accès donnée sécurité élément modèle système déjà être fonctionnalité".split(),
    "zh": "网络 架构 协议 用户 数据 会话 管理 服务 质量 方案 讨论 建议".split(),
}
WRONG = {
    "latin": lambda s: s.encode().decode("latin-1"), "cp1252": lambda s: s.encode().decode("cp1252", "replace"), "twice": lambda s: s.encode().decode("latin-1").encode().decode("latin-1"),
    "lost": lambda s: re.sub("[\x80-\x9f]", "", s.encode().decode("latin-1")), "koi8": lambda s: s.encode("koi8_r").decode("cp1251"), "gb": lambda s: s.encode("gb2312").decode("latin-1"), "dos": lambda s: s.encode().decode("cp437"),
}


def test_planted_originals_come_back(spark):
    """At least 97 of 100 garbled words are restored, at most 1 of 100 to another word, and no sound document is found."""
    rng = random.Random(5)
    text = lambda ws: " ".join(rng.choice(ws) if rng.random() < 0.7 else rng.choice("the network shall support session control".split()) for _ in range(25))
    docs, planted = [], {}
    for ws in WORDS.values():
        docs += [text(ws) for _ in range(150)]
        for wrong in WRONG.values():
            for _ in range(3):
                try:
                    sound = text(ws)
                    planted[len(docs)] = sound
                    docs.append(wrong(sound))
                except UnicodeEncodeError:
                    del planted[len(docs)]
    found = {}
    for r in mojibake.garbled_places(table(spark, list(enumerate(docs))), "id", "t").collect():
        found.setdefault(r.doc_id, {})[r.word] = r.fixed
    assert set(found) <= set(planted) and all(docs[d] == planted[d] for d in set(planted) - set(found))
    right = wrong = every = 0
    for d, sound in planted.items():
        for a, b in zip(sound.split(" "), re.split(f"[ {mojibake._BREAKS}]", docs[d]), strict=True):
            if a != b:
                fixed = found[d].get(b)
                every, right, wrong = every + 1, right + (fixed == a), wrong + (fixed not in (None, a, b))
    assert right >= 0.97 * every and wrong <= 0.01 * every
