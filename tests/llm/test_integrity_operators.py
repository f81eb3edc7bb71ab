"""Manifest, byte pairs and repair of conversations against plain versions, the tokenizers library and their SQL."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import zlib
from array import array

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loquent.llm import bpe, dialogue, merkle, oracles, queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def plain_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["source"], []).append(r)
    built = {}
    for source, own in trees.items():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        built[source] = levels([leaf(r) for r in own])
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([built[s][-1][0] for s in sources])
    for place, source in enumerate(sources):
        for i, row in enumerate(trees[source]):
            siblings = []
            for tree, k in ((built[source], i), (top, place)):
                for nodes in tree[:-1]:
                    first = k - k % 3
                    siblings.append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + 3])))
                    k //= 3
            own = folded = leaf(row)
            if row["doc_id"] is not None and row["text"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                folded = leaf(row | {"text": row["text"].replace("\n", "")})
            for a, b in siblings:
                folded = digest(a, folded, b)
            yield row["doc_id"], own, built[source][-1][0], top[-1][0], digest(*(a + b for a, b in siblings)), folded, folded == top[-1][0]


def same(got, want):
    key = lambda row: tuple(map(str, row))
    return sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_manifest_equals_plain_version(spark, edged, tmp_path):
    """With null sources and ids, repeated rows, sources of one row, and rows that end runs of one and two."""
    docs = spark.read.parquet(f"{edged}/documents.parquet")
    more = [(None, "a", "late", None, 1), (None, "a", "late", None, 1), (5, "b\nc", None, "en", None), (5, "b\nc", None, "en", None), (77, None, "é", "", 3), (78, "\n", "", "", 3)]
    docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, source string, lang string, n_chars long")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [r.asDict() for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    got = queries.op11_manifest(spark, str(tmp_path)).collect()
    assert same(got, plain_manifest(rows))
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("many, step", [(1, 2), (2, 4), (3, 1), (27, 3), (28, 3), (81, 2), (250, 1), (250, 2), (250, 3)])
def test_manifest_of_one_source_at_any_step(spark, many, step):
    docs = spark.range(many).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("t"), "id").alias("text"), F.lit("x").alias("node"), F.lit("y").alias("place"))
    got = merkle.prove(docs, spark, ["doc_id", "text"], step=step).collect()
    want = levels([digest(f"{len(str(i))}:{i}", f"{len(str(i)) + 1}:t{i}") for i in range(many)])
    assert {r.root for r in got} == {want[-1][0]} and len(got) == many
    assert all(len(r.proof) == len(want) - 1 for r in got)
    for r in got:
        node = r.leaf
        for s in r.proof:
            node = digest(s.left or "", node, s.right or "")
        assert node == r.root


def test_manifest_of_nothing(spark, empty):
    assert merkle.prove(empty, spark, FIELDS).collect() == []


def test_manifest_keeps_only_every_few_levels(spark):
    rows = spark.range(300).select(F.lit(0).alias("t"), "id", F.sha2(F.col("id").cast("string"), 256).alias("node"))
    from loquent.llm.scratch import Scratch

    trees = merkle.Trees(spark, Scratch(spark), rows, "t", ["id"], step=4)
    assert [x.count() for x in trees.levels] == [300, 4, 1]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer())


def test_byte_pairs_equal_the_library(spark, edged):
    own, rows = library(), queries.op12_byte_pairs(spark, edged).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{edged}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = own.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(",".join(map(str, ids))))
        assert r.decoded_sha256 == digest(own.decode(ids, skip_special_tokens=False))


def test_byte_pairs_of_all_characters_and_of_odd_texts():
    own, mine = library(), bpe.bpe(queries.tokenizer())
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 97 == 0)]
    texts = ["".join(f"a{c}b {c} 1{c}!{c}{c}" for c in characters[i : i + 60]) for i in range(0, len(characters), 60)]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab  \n'tslevr12.!?é日 \x1c\x85") for _ in range(rng.randrange(70))) for _ in range(3000)]
    texts += ["", " ", "a" * 10_001, "ab" * 5_000, "<|endoftext|>", "x<|endoftext|><|endoftext|> y<|endoftext", "it's we'll I'D 'tis"]
    for text, ids in zip(texts, mine.ids(texts), strict=True):
        want = own.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<i4").tolist() == want
        assert mine.text(np.array(want)) == own.decode(want, skip_special_tokens=False)


def test_byte_pairs_do_not_depend_on_what_is_remembered(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    monkeypatch.setattr(bpe, "LONG", 4)
    own, mine = library(), bpe.Bpe(queries.tokenizer())
    for text in ("some words of some length", "words of length again", "some words again", "other", "some other words"):
        assert np.frombuffer(mine.ids([text])[0], "<i4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_byte_pairs_of_edge_rows(spark, edges, empty):
    docs = edges.withColumn("ids", F.lit("mine")).withColumn("decoded", F.lit("too"))
    out = bpe.encode(docs, spark, queries.tokenizer(), decoded="decoded")
    assert {"ids", "ids_", "decoded", "decoded_"} <= set(out.columns) and "text" not in out.columns
    rows = out.collect()
    texts = sorted(r.text or "" for r in edges.collect())
    assert sorted(r.decoded_ for r in rows) == texts and {r.ids for r in rows} == {"mine"}
    back = bpe.decode(out, spark, queries.tokenizer(), "ids_", "again").collect()
    assert sorted(r.again for r in back) == texts
    assert bpe.encode(empty, spark, queries.tokenizer()).collect() == []


def test_decoding_of_odd_ids(spark):
    rows = spark.createDataFrame([(1, [464, None, -3, 10**6, 50256]), (2, None), (3, []), (4, [167, 242])], "k int, ids array<int>")
    own = {r.k: r.decoded for r in bpe.decode(rows, spark, queries.tokenizer()).collect()}
    assert own == {1: "The<|endoftext|>", 2: None, 3: "", 4: library().decode([167, 242], skip_special_tokens=False)}


def test_byte_pairs_refuse_other_files(tmp_path):
    import json

    told = json.load(open(queries.tokenizer()))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": told["model"] | {"merges": [told["model"]["merges"][k] for k in (5, 5)]}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(told | change))
        with pytest.raises(ValueError):
            bpe.Bpe(str(path))


def damaged(rows):
    for r in rows:
        conv, turn, role, text = (" " if v is None else v for v in r)
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(kind, text)
        yield from [(r[0], r[1], "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)


def faults_of(rows):
    seen = set()
    for _, _, role, text in rows:
        held = text.rstrip(" \t\n\x0b\x0c\r")
        yield "blank" if not held else "duplicate" if (role, text) in seen else "" if held[-1] in ".!?" else "truncated"
        seen.add((role, text))


def cheapest(rows, faults):
    """Shortest path over (rows taken, last role), least cost first and then least letters."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, letters, i, last, made = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, letters, made
        wanted = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 5, letters + "I", i, wanted[0], (*made, (wanted, ""))))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, last, made))
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + 1 + more, letters + "R", i + 1, wanted[0], (*made, (wanted, text))))
                if role[:1] == wanted[0] or role[:1] == "s" and not last:
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, role[0], (*made, (role, text))))


def plain_repairs(rows):
    groups = {r[0]: [] for r in rows}
    for r in damaged(rows):
        groups[r[0]].append(r)
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(f"{len(r[2])}:", r[2], r[3])))
        faults, turns = list(faults_of(own)), [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, letters, made = cheapest(own, faults)
        yield conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, digest("\n".join(f"{a}:{b}" for a, b in made))


def test_repairs_equal_shortest_paths(spark, sf_dir, tmp_path):
    """Null ids, turns, roles and texts, equal turns, repeated rows, roles unknown to the grammar, long conversations."""
    rng = random.Random(11)
    some = lambda *values: rng.choice(values)
    rows = [(some(None, -1, -2, -3, -4), some(None, *range(40)), some("user", "assistant", "system", "tool", "", None), some("Yes.", "No", "", None, " \n", "Why?", "so!\t")) for _ in range(300)]
    rows += [(-10, i, "user" if i < 500 else "assistant", f"line {i}.") for i in range(1500)] + [(-11, i, ("user", "assistant")[i % 2], f"cut {i}") for i in range(999)]
    base = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    base.unionByName(spark.createDataFrame(rows, base.schema)).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    whole = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/conversations.parquet").collect()]
    assert same(queries.op13_conversations(spark, str(tmp_path)).collect(), plain_repairs(whole))


def test_audits_are_the_cheapest_and_least():
    rng = random.Random(5)
    for _ in range(2000):
        rows = [(0, 0, rng.choice(["user", "assistant", "system", "tool"]), "x") for _ in range(rng.randrange(9))]
        faults = [rng.choice(["", "", "", "blank", "duplicate", "truncated"]) for _ in rows]
        symbols = [4 * ["system", "user", "assistant", "tool"].index(r[2]) + ["", "blank", "duplicate", "truncated"].index(f) for r, f in zip(rows, faults, strict=True)]
        runs = [(k, len(list(g))) for k, g in itertools.groupby(symbols)]
        assert dialogue.audit(array("b", [k for k, _ in runs]), array("q", [n for _, n in runs])) == cheapest(rows, faults)[:2]


def test_a_long_run_takes_few_steps():
    cost, letters = dialogue.audit(array("b", [4]), array("q", [1_000_001]))
    assert (cost, len(letters), letters[:4]) == (500_002, 1_000_001, "DKRK")
    assert dialogue._advance.cache_info().maxsize and max(k for k in range(20) if dialogue._power(4, k)) == 19


def test_repaired_rows_follow_the_grammar(spark, sf_dir):
    import re

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    own = dialogue.Repair(spark, dialogue.damage(rows).withColumn("audit", F.lit("clash")))
    found = {}
    for r in own.repaired().collect():
        found.setdefault(r.conv_id, {})[r.place] = r.role[0]
    for places in found.values():
        assert re.fullmatch("s?(ua)+", "".join(places[i] for i in range(len(places))))


def test_repairs_of_nothing(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert dialogue.repair(rows.limit(0), rows.limit(0), spark).collect() == []
    got = dialogue.repair(rows.limit(0), rows, spark).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", digest(""))}


@pytest.mark.parametrize("name", ["op11_manifest", "op13_conversations"])
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    got = queries.queries()[name](spark, sf_dir)
    want = con.execute(oracles.oracle_sql()[name])
    assert got.columns == [c[0] for c in want.description]
    assert same(got.collect(), want.fetchall())
