"""Variant spellings of names typed by people, linked to the entries of a register.

The words of all register names, and every name written in one piece, form tries. A typed
value is cleaned (additions in brackets, legal forms), its words walk the tries with a
Levenshtein automaton (transpositions count one) whose bound grows with the word length,
and the words found are laid over the words of each entry in any order, by a least-cost
assignment for names of any number of words. Abbreviations, initials, short first names and
acronyms are further ways for a word to stand for another. The entry of least cost wins;
a tie between entries links nothing.

The tries are sharded by prefix into shards of at most ``TRIE_NAMES`` keys. The same
automaton, run over the prefixes alone, routes a typed value to the shards that can hold a
near word, where it meets the entries of that shard, side by side with other shards and,
where many values ask one shard, with other tasks over copies of it. Which words are
generic is found over the whole register, and entries that may win or tie are kept from
every shard, so that the links are the same for any number of shards.

Defined results: null, blank and bracket-only values mean nobody; repeated rows count
once; with an empty register nothing is linked.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.confusables import consistent_form
from docketlake.operators.packed import LEGAL_FORMS, agenda_values
from docketlake.session import checkpoint, even, table

TRIE_NAMES = 20_000
PREFIX = 12
VALUES_PER_TASK = 20_000
MAX_COST = 3.0
CLEAR = 0.25  # entries this close to the best are a tie
_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_WORDS = re.compile(r"[^\W_]+")
_LEGAL = re.compile(
    r"(?<![^\W_])(?:co\.?,?\s*ltd|" + "|".join(sorted((r"\.?\s?".join(f.lower()) if len(f) == 2 and f.isupper() else f.lower() for f in LEGAL_FORMS), key=len, reverse=True)) + r")(?![^\W_])\.?"
)


class Node:
    """A place in a trie: children by character, the word that ends here, and the least and greatest length of a word below."""

    __slots__ = ("children", "word", "least", "most")

    def __init__(self):
        self.children: dict[str, Node] = {}
        self.word: str | None = None
        self.least, self.most = 1 << 30, 0


class Trie:
    """Words with a bounded search by a Levenshtein automaton.

    The automaton's states are bit sets, one for each number of edits so far: bit i stands for
    i characters of the typed word read. A swap of neighbours counts one.
    """

    def __init__(self, words: Iterable[str]):
        self.root = Node()
        for w in words:
            node = self.root
            node.least, node.most = min(node.least, len(w)), max(node.most, len(w))
            for ch in w:
                node = node.children.setdefault(ch, Node())
                node.least, node.most = min(node.least, len(w)), max(node.most, len(w))
            node.word = w

    def get(self, word: str) -> Node | None:
        node = self.root
        for ch in word:
            if (node := node.children.get(ch)) is None:
                return None
        return node

    def near(self, word: str, bound: int) -> dict[str, int]:
        """Words within ``bound`` edits, with their number."""
        if bound == 0:
            return {word: 0} if (node := self.get(word)) and node.word == word else {}
        return {node.word: d for node, d in self._walk(word, bound, True)}

    def alive(self, word: str, bound: int) -> set[str]:
        """Words of the trie that begin a word within ``bound`` edits of the typed one."""
        return {node.word for node, _ in self._walk(word, bound, False)}

    def _walk(self, word: str, bound: int, whole: bool) -> Iterator[tuple[Node, int]]:
        n = len(word)
        if whole and (n > self.root.most + bound or n < self.root.least - bound):
            return
        final, full = 1 << n, (2 << n) - 1
        masks: dict[str, int] = {}
        for i, ch in enumerate(word):
            masks[ch] = masks.get(ch, 0) | 1 << i
        two = bound > 1
        top = n + bound if whole else 1 << 30
        low = n - bound if whole else 0
        stack = [(self.root, 1, 3 & full, 7 & full if two else 0, 0, 0, 0)]
        if not whole and self.root.word is not None:
            yield self.root, 0
        while stack:
            node, r0, r1, r2, p0, p1, last = stack.pop()
            for ch, child in node.children.items():
                if child.least > top or child.most < low:
                    continue
                m = masks.get(ch, 0)
                swap = m & last >> 1
                n0 = (r0 & m) << 1
                n1 = ((r1 & m) << 1 | r0 | r0 << 1 | n0 << 1 | (p0 & swap) << 2) & full
                if two:
                    n2 = ((r2 & m) << 1 | r1 | r1 << 1 | n1 << 1 | (p1 & swap) << 2) & full
                    if not n2:
                        continue
                else:
                    n2 = 0
                    if not n1:
                        continue
                if child.word is not None:
                    if not whole:
                        yield child, 0
                    elif (n2 if two else n1) & final:
                        yield child, 0 if n0 & final else 1 if n1 & final else 2
                if child.children:
                    stack.append((child, n0, n1, n2, r0, r1, m))


def edit_bound(length: int) -> int:
    return 0 if length < 4 else 1 if length < 7 else 2


def clean(value: str) -> tuple[list[str], str]:
    """Words and legal form of a written name."""
    s = consistent_form(value).casefold()
    while (t := _BRACKETS.sub(" ", s)) != s:
        s = t
    legal = [re.sub(r"\W", "", m) for m in _LEGAL.findall(s)]
    s = _LEGAL.sub(" ", s)
    return [w for w in _WORDS.findall(s) if w != "and"], "".join(legal[-1:])


def _shortens(short: str, word: str, generic: bool) -> bool:
    """A prefix of the word or, for words of trade, its first letter and further letters in order (comms, nwks)."""
    if len(short) < 2 or len(short) >= len(word) - 1 or short[0] != word[0]:
        return False
    if word.startswith(short):
        return True
    it = iter(word)
    return generic and len(short) > 2 and all(c in it for c in short)


def _forms(name: str, kind: str | None, aliases) -> Iterator[tuple[list[str], str, str]]:
    """(words, legal form, kind) of a name and of its aliases."""
    for k, form in enumerate([name, *(aliases if aliases is not None else ())]):
        if form and form.strip():
            words, legal = clean(form)
            if words:
                yield words, legal, "alias" if k else kind or ""


def _word_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(entry_id, word, first, proper) for every word of every form; proper: behind the first in a name that counts."""
    for pdf in batches:
        rows = [
            (eid, w, i == 0, i > 0 and kind not in ("alias", "delegate"))
            for eid, name, k, aliases in zip(pdf["entry_id"], pdf["name"], pdf["kind"], pdf["aliases"], strict=True)
            for words, _, kind in _forms(name, k, aliases)
            for i, w in enumerate(words)
        ]
        yield pd.DataFrame(rows, columns=["entry_id", "word", "first", "proper"])


def with_generic(register: DataFrame) -> DataFrame:
    """The register with the words of each entry that are generic: never first in a name and shared by more than two entries."""
    places = register.mapInPandas(_word_places, "entry_id long, word string, first boolean, proper boolean")
    places = places.groupBy("word", "entry_id").agg(F.max("first").alias("first"), F.max("proper").alias("proper"))
    generic = places.groupBy("word").agg(F.max("first").alias("first"), F.sum(F.col("proper").cast("int")).alias("n")).where("n > 2 and not first").select("word")
    own = places.join(generic, "word").groupBy("entry_id").agg(F.collect_list("word").alias("generic"))
    return register.join(own, "entry_id", "left")


def assign(options: list[list[tuple[float, int]]], supply: list[int], room: list[int]) -> float | None:
    """Least cost of giving every one of ``supply`` equal rows a place, of which there are ``room`` equal ones; options are (cost, place).

    A cheapest flow by shortest augmenting paths; repeated words are one row with a number, so long names of few different words are short here.
    """
    rows, places = len(supply), len(room)
    flow: list[dict[int, int]] = [{} for _ in range(places)]  # place -> row -> how many
    cost = [{k: c for c, k in reversed(sorted(opts))} for opts in options]
    left, free, total = list(supply), list(room), 0.0
    while any(left):
        # nodes: rows, then places; from every row that still has some
        dist = [0.0 if n else math.inf for n in left] + [math.inf] * places
        came = [-1] * (rows + places)
        queue = deque(i for i in range(rows) if left[i])
        waits = set(queue)
        while queue:
            u = queue.popleft()
            waits.discard(u)
            steps = ((rows + k, c) for k, c in cost[u].items()) if u < rows else ((i, -cost[i][u - rows]) for i, n in flow[u - rows].items() if n)
            for v, c in steps:
                if dist[u] + c < dist[v] - 1e-9:
                    dist[v], came[v] = dist[u] + c, u
                    if v not in waits:
                        waits.add(v)
                        queue.append(v)
        end = min((k for k in range(places) if free[k]), key=lambda k: dist[rows + k], default=-1)
        if end < 0 or dist[rows + end] == math.inf:
            return None
        path = [rows + end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        path.reverse()
        n = min(left[path[0]], free[end], *(flow[u - rows][v] for u, v in zip(path, path[1:]) if u >= rows))
        for u, v in zip(path, path[1:]):
            if u < rows:
                flow[v - rows][u] = flow[v - rows].get(u, 0) + n
            else:
                flow[u - rows][v] -= n
        left[path[0]] -= n
        free[end] -= n
        total += n * dist[rows + end]
    return total


def _acronym(words: list[str], kind: str) -> str | None:
    return "".join(w[0] for w in words) if len(words) > 2 and kind not in ("alias", "delegate") else None


class Register:
    """Entries (entry id, name, kind, aliases, generic words of the entry) of one trie shard."""

    def __init__(self, entries: Iterable[tuple]):
        self.entries: list[tuple[int, list[str], str, str]] = []  # id, words, legal, kind
        self.generic: set[str] = set()
        for eid, name, kind, aliases, generic in entries:
            self.entries += [(eid, *form) for form in _forms(name, kind, aliases)]
            self.generic.update(generic if generic is not None else ())
        holders = defaultdict(set)
        for i, (_, words, _, _) in enumerate(self.entries):
            for w in words:
                holders[w].add(i)
        self.holders = holders
        self.laid = [self._laid(words) for _, words, _, _ in self.entries]
        self.acronyms = defaultdict(set)
        for eid, words, _, kind in self.entries:
            if short := _acronym(words, kind):
                self.acronyms[short].add(eid)
        self.joined = defaultdict(set)
        for i, (_, words, legal, _) in enumerate(self.entries):
            for form in ("".join(words), "".join(words) + legal):
                self.joined[form].add(i)
        self.by_initial = defaultdict(set)
        for w in holders:
            self.by_initial[w[0]].add(w)
        self.trie, self.whole = Trie(holders), Trie(self.joined)
        self.near_word = lru_cache(200_000)(self._near_word)
        self.near_whole = lru_cache(200_000)(lambda form: self.whole.near(form, edit_bound(len(form))))

    def _near_word(self, word: str) -> dict[str, float]:
        """Register word -> cost of the typed word standing for it."""
        out: dict[str, float] = dict(self.trie.near(word, edit_bound(len(word))))
        for w in self.by_initial[word[0]]:
            if w not in out and (w in self.generic or len(word) > 2) and _shortens(word, w, w in self.generic):
                out[w] = 0.3
        return out

    def _laid(self, words: list[str]) -> tuple:
        """An entry's different words, how many of each, what each is worth, which are proper, and what all are worth."""
        places = Counter(words)
        # a word that is missing costs; one that is there saves that
        worth = [0.5 if w in self.generic else 1.5 for w in places]
        return list(places), list(places.values()), worth, {k for k, w in enumerate(places) if w not in self.generic}, sum(w * n for w, n in zip(worth, places.values(), strict=True))

    def _cost(self, rows: dict[str, int], size: int, legal: str, i: int) -> float | None:
        """Words (with their number) laid over an entry's words in any order; None if one is left over."""
        _, words, own_legal, kind = self.entries[i]
        if size > len(words):
            return None
        kinds, room, worth, proper, all_worth = self.laid[i]
        if not proper:
            return None
        saved = []
        for t in rows:
            near = self.near_word(t)
            opts = [(near[w] - worth[k], k) for k, w in enumerate(kinds) if w in near]
            if len(t) == 1:
                opts += [(0.4 - worth[k], k) for k, w in enumerate(kinds) if w[0] == t and (kind == "delegate" or w in self.generic)]
            if not opts:
                return None
            opts.sort()
            saved.append(opts)
        supply = list(rows.values())
        wanted: dict[int, int] = {}
        for opts, n in zip(saved, supply, strict=True):
            wanted[opts[0][1]] = wanted.get(opts[0][1], 0) + n
        if all(n <= room[k] for k, n in wanted.items()):  # each takes the place it fits best
            best, used = sum(opts[0][0] * n for opts, n in zip(saved, supply, strict=True)), set(wanted)
        else:
            best, used = assign(saved, supply, room), None
        if best is None:
            return None
        if used is None or not used & proper:
            # part of the name proper must be there: one of the typed words takes such a place
            forced = []
            for i, opts in enumerate(saved):
                for c, k in opts:
                    if k in proper:
                        rest = assign(saved, [n - (j == i) for j, n in enumerate(supply)], [n - (j == k) for j, n in enumerate(room)])
                        forced.append(None if rest is None else c + rest)
            best = min((f for f in forced if f is not None), default=None)
            if best is None:
                return None
        total = best + all_worth
        if legal != own_legal:
            total += 0.2 if not legal else 1.2 if own_legal else 1.0
        return total

    def match(self, value: str) -> list[tuple[int, float]]:
        """(entry id, cost) of the entry that fits best and of those that tie with it."""
        typed, legal = clean(value)
        if not typed:
            return []
        costs: dict[int, float] = {}

        def offer(eid: int, cost: float) -> None:
            if cost <= MAX_COST and cost < costs.get(eid, MAX_COST + 1):
                costs[eid] = cost

        tried = set()
        for t in typed:
            for w in self.near_word(t):
                if w not in self.generic:
                    tried |= self.holders[w]
        rows = Counter(typed)
        for i in tried:
            if (c := self._cost(rows, len(typed), legal, i)) is not None:
                offer(self.entries[i][0], c)
        one = "".join(typed)
        for form in {one, one + legal}:
            for near, d in self.near_whole(form).items():
                for i in self.joined[near]:
                    offer(self.entries[i][0], d + 0.1)
        if len(one) > 2 and one in self.acronyms and (len(typed) == 1 or len(one) == len(typed)):
            for eid in self.acronyms[one]:
                offer(eid, 0.5)
        low = min(costs.values(), default=0.0)
        return [(e, c) for e, c in costs.items() if c <= low + CLEAR + 1e-9]


END = "\x00"  # ends a key, so that each has a prefix that is no other's


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(entry_id, key): by what a typed value can meet an entry: its words but the generic ones, its joined forms, its acronym."""
    for pdf in batches:
        rows = set()
        for eid, name, kind, aliases, generic in pdf[["entry_id", "name", "kind", "aliases", "generic"]].itertuples(index=False):
            own = set(generic) if generic is not None else set()
            for words, legal, k in _forms(name, kind, aliases):
                keys = {w for w in words if w not in own} | {"".join(words), "".join(words) + legal, _acronym(words, k)} - {None}
                rows |= {(eid, key + END) for key in keys}
        yield pd.DataFrame(sorted(rows), columns=["entry_id", "key"])


def trie_shards(keys: DataFrame, trie_names: int) -> list[tuple[str, int]]:
    """(prefix, parts) of the shards: the shortest prefixes that at most ``trie_names`` keys begin with.

    A prefix of PREFIX characters, or of a whole key, is not made longer; one that more keys share has several parts, by entry.
    """
    cut = keys.select("key", F.explode(F.sequence(F.lit(0), F.least(F.length("key"), F.lit(PREFIX)))).alias("n"))
    counts = cut.select(F.substring("key", F.lit(1), F.col("n")).alias("p"), "n").groupBy("p", "n").count()
    big = counts.where(F.col("count") > trie_names).select(F.col("p").alias("up"))
    own = counts.withColumn("up", F.substring("p", F.lit(1), F.greatest(F.col("n") - 1, F.lit(0))))
    small = own.where((F.col("count") <= trie_names) | (F.col("n") == PREFIX) | F.col("p").endswith(END))
    chosen = small.where("n = 0").drop("up").unionByName(small.where("n > 0").join(big, "up", "left_semi").drop("up"))
    # about (keys / trie_names) x the characters in use
    return sorted((r.p, -(-r["count"] // trie_names)) for r in chosen.collect())


class Shards:
    """Which shards a typed value, and which shard a key belongs to."""

    def __init__(self, prefixes: list[str]):
        self.number = {p: i for i, p in enumerate(prefixes)}
        self.trie = Trie(prefixes)
        self.reached = lru_cache(200_000)(self._reached)

    def of_key(self, key: str) -> int:
        return next(self.number[key[:n]] for n in range(PREFIX + 1) if key[:n] in self.number)

    def _reached(self, word: str) -> frozenset[int]:
        if "" in self.number:
            return frozenset((self.number[""],))
        found = self.trie.alive(word, max(edit_bound(len(word)), 1))
        # words it shortens begin with it
        node = self.trie.get(word)
        stack = [node] if node else []
        while stack:
            node = stack.pop()
            if node.word is not None:
                found.add(node.word)
            stack += node.children.values()
        return frozenset(self.number[p] for p in found)

    def of_value(self, value: str) -> set[int]:
        typed, legal = clean(value)
        one = "".join(typed)
        return set().union(*map(self.reached, {*typed, one, one + legal})) if typed else set()


def link_names(values: DataFrame, value: str, register: DataFrame, trie_names: int = TRIE_NAMES) -> DataFrame:
    """(value, entry_id) for every distinct value that means one entry of register(entry_id, name, kind, aliases)."""
    sc = values.sparkSession.sparkContext
    typed = values.select(F.col(value).alias("value")).where("trim(value) <> ''").distinct()
    register = register.select(F.col("entry_id").cast("bigint").alias("entry_id"), "name", "kind", "aliases").where("entry_id is not null and name is not null").dropDuplicates(["entry_id"])
    register = checkpoint(with_generic(register))
    keys = register.mapInPandas(_keys, "entry_id long, key string")
    parts = trie_shards(keys, trie_names)
    shards = sc.broadcast([p for p, _ in parts])

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Shards(shards.value)
        for pdf in batches:
            yield pd.DataFrame({"entry_id": pdf["entry_id"], "shard": [of.of_key(k) for k in pdf["key"]]})

    def routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Shards(shards.value)
        for pdf in batches:
            rows = [(v, s) for v in pdf["value"] for s in of.of_value(v)]
            yield pd.DataFrame(rows, columns=["value", "shard"])

    routed = checkpoint(even(typed).mapInPandas(routes, "value string, shard int"))
    asked = {r.shard: r["count"] for r in routed.groupBy("shard").count().collect()}  # a row per shard
    tasks = 4 * sc.defaultParallelism
    per_task = min(VALUES_PER_TASK, max(100, -(-sum(asked.values()) // tasks)))
    plan = [(s, part, salt, parts[s][1], -(-n // per_task)) for s, n in asked.items() for part in range(parts[s][1]) for salt in range(-(-n // per_task))]
    groups, others = (values.sparkSession.createDataFrame(plan, "shard int, part int, salt int, parts int, salts int") for _ in range(2))
    n = max(sc.defaultParallelism, len(plan) // 4)
    at = ["shard", "part", "salt"]
    home = keys.mapInPandas(homes, "entry_id long, shard int").distinct().join(groups, "shard").where(F.pmod(F.xxhash64("entry_id"), "parts") == F.col("part"))
    entries = home.join(register, "entry_id").select(*at, "entry_id", "name", "kind", "aliases", "generic").repartition(n, *at)
    questions = routed.join(others, "shard").where(F.pmod(F.xxhash64("value"), "salts") == F.col("salt")).select(*at, "value").repartition(n, *at)

    def search(asked: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        reg = Register(entries[["entry_id", "name", "kind", "aliases", "generic"]].itertuples(index=False))
        return pd.DataFrame([(v, *m) for v in asked["value"] for m in reg.match(v)], columns=["value", "entry_id", "cost"])

    found = questions.groupBy(*at).cogroup(entries.groupBy(*at)).applyInPandas(search, "value string, entry_id long, cost double")
    # a value may meet an entry in several shards; entries close to the best of all tie
    found = found.groupBy("value", "entry_id").agg(F.min("cost").alias("cost"))
    offers = found.groupBy("value").agg(F.min_by("entry_id", "cost").alias("entry_id"), F.sort_array(F.collect_list("cost")).alias("costs"))
    return offers.where((F.size("costs") == 1) | (F.col("costs")[1] > F.col("costs")[0] + CLEAR + 1e-9)).select("value", "entry_id")


def p4_found(spark, sf_dir: str) -> DataFrame:
    reg = table(spark, sf_dir, "companies").withColumnRenamed("company_id", "entry_id")
    cells = checkpoint(agenda_values(spark, sf_dir, ("source",)).select("row_id", "pos", "value"))  # split once for both uses
    links = link_names(cells, "value", reg)
    names = reg.select("entry_id", "name")
    links = links.join(names, "entry_id").where("value <> name").select("value", F.col("entry_id").alias("company_id"))
    return cells.join(links, "value").select("row_id", "pos", "company_id")
