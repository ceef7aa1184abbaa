"""Whole results of operators that SQL cannot express, against plain versions; clashing names in every stage."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from graphloom.llm import chat, decontaminate, entries, langid, licenses, lm, packing, pii, sieve, simhash, similar, token_files
from graphloom.llm.tokens import Encoder, default_path
from tests.oracle import SMALL


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return docs.toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def ids(plain):
    tokenizer = Encoder(default_path()).tokenizer
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in plain.text]


def test_encoder_equals_tokenizer():
    rng = random.Random(4)
    signs = [chr(c) for c in [*range(9, 14), *range(32, 0x250), *range(0x2010, 0x2060), 0x3A3, 0x130, 0x4E00]]
    texts = ["".join(rng.choice(signs if rng.random() < 0.3 else "aBt's'll  09_-\n") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", " ", "<|endoftext|>", "x <|startoftext|>"]
    for name in (default_path(), default_path().replace("word_bpe_49k", "byte_bpe_50k")):
        e = Encoder(name)
        assert e.by_rule == ("word" in name)
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_all(texts)] == [[*e.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_op1(spark, docs, plain, ids):
    got = entries.QUERIES["op1_token_files"](spark, SMALL).toPandas().sort_values("doc_id")
    size = [len(i) for i in ids]
    assert got.doc_id.tolist() == plain.doc_id.tolist() and got.n_tokens.tolist() == size
    assert got.start.tolist() == (np.cumsum(size) - size).tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(i.tobytes()) for i in ids]


def test_short_access_reads_few_blocks(spark, docs, plain, ids, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_DOCS", 10)
    files = token_files.write_token_files(docs.repartition(3))
    assert files.blocks(spark).count() >= len(plain) // 10
    wanted = plain.doc_id.tolist()[17]
    assert token_files.blocks_of(spark, files, [wanted]).count() <= 2
    assert token_files.read_ids(spark, files, [wanted, 10**9]) == {wanted: ids[17].tolist()}
    assert token_files.spread(bytes(range(256)) * 400, 8, 64)[-64:] == bytes(range(192, 256))


def test_op3(spark, plain, ids):
    got = entries.QUERIES["op3_packing"](spark, SMALL).toPandas()
    want = {(d, k // 4096): (k, len(x[k : k + 4096]), zlib.crc32(x[k : k + 4096].tobytes())) for d, x in zip(plain.doc_id, ids, strict=True) for k in range(0, len(x), 4096)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (np.cumsum(g.length) - g.length).tolist() and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) * 1.02 + 1


def _plain_base(text):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda r: (r[0], ["email", "ip", "card", "phone"].index(r[1])))


def test_op4(spark, plain):
    folder = SMALL.replace("0.001", "0.01")
    got = entries.QUERIES["op4_pii"](spark, folder).toPandas().set_index("doc_id")
    added = 0
    for r in pd.read_parquet(f"{folder}/documents.parquet").itertuples():
        base, g = _plain_base(r.text or ""), got.loc[r.doc_id]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == x for _, k, _ in base) for x in ("email", "ip", "card", "phone")]
        spans = [f"{k}:{s}:{e}" for s, k, e in base]
        assert g.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        every = g.spans.split(",") if g.spans else []
        assert set(spans) <= set(every) and len(every) == len(spans) + g.n_added
        assert [int(x.split(":")[1]) for x in every] == sorted(int(x.split(":")[1]) for x in every)
        added += g.n_added
    assert added > 0  # the model finds what the base patterns do not


def test_reliabilities_are_recovered():
    """Votes drawn from known labelers: estimates come near, true patterns are accepted and false ones refused."""
    rng = np.random.default_rng(5)
    # chance of the right vote, the wrong one, else none
    right, wrong = np.array([0.8, 0.9, 0.7, 0.6, 0.3, 0.3]), np.array([0.1, 0.05, 0.2, 0.02, 0.02, 0.02])
    counts: dict[int, int] = {}
    truths: dict[int, list[int]] = {}
    for _ in range(20_000):
        true = rng.random() < 0.4
        u = rng.random(6)
        vote = np.where(u < right, 1, np.where(u < right + wrong, -1, 0)) * (1 if true else -1)
        vote[4:], vote[3] = np.minimum(vote[4:], 0), max(vote[3], 0)  # cues only speak for, counters only against
        code = pii._code("secret", tuple(int(x) for x in vote))
        counts[code] = counts.get(code, 0) + 1
        truths.setdefault(code, []).append(true)
    model = pii.fit(counts)
    assert np.abs(np.array(model.reliability["secret"])[:3] - (right / (right + wrong))[:3]).max() < 0.1
    taken = [t for c, ts in truths.items() if c in model.accepted for t in ts]
    refused = [t for c, ts in truths.items() if c not in model.accepted for t in ts]
    assert len(taken) > 4000 and np.mean(taken) > 0.95 and np.mean(refused) < 0.2


def _plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op6(spark, plain):
    got = entries.QUERIES["op6_simhash"](spark, SMALL).toPandas().sort_values("doc_id")
    fp = [_plain_fingerprint(t) for t in plain.text]
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in fp]
    comp = list(range(len(fp)))
    for i, j in itertools.combinations(range(len(fp)), 2):
        if comp[i] != comp[j] and (fp[i] ^ fp[j]).bit_count() <= 3:
            lo, hi = sorted((comp[i], comp[j]))
            comp = [lo if c == hi else c for c in comp]
    assert got.component_id.tolist() == plain.doc_id[comp].tolist()


def test_op7(spark, docs, plain):
    got = entries.QUERIES["op7_language"](spark, SMALL).toPandas().set_index("doc_id")
    assert {d: bool(h) for d, h in got.held_out.items()} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in plain.doc_id}
    # code lengths by dictionaries of counts, byte by byte
    train = plain[np.array([zlib.crc32(str(d).encode()) % 5 != 0 for d in plain.doc_id]) & plain.lang.notna() & plain.text.notna()]
    tables = {}
    for lang, texts in train.groupby("lang").text:
        seen = tables[lang] = [{} for _ in range(langid.ORDER + 1)]
        for t in set(texts):
            b = bytes(langid.ORDER) + t.encode().lower()
            for i in range(langid.ORDER, len(b)):
                for k in range(langid.ORDER + 1):
                    after = seen[k].setdefault(b[i - k : i], {})
                    after[b[i]] = after.get(b[i], 0) + 1

    def bits(text, seen):
        b, out = bytes(langid.ORDER) + text.encode().lower(), 0.0
        for i in range(langid.ORDER, len(b)):
            for k in range(langid.ORDER, -1, -1):
                after = seen[k].get(b[i - k : i])
                if after is None:
                    continue
                whole = sum(after.values()) + len(after)
                if b[i] in after:
                    out += np.log2(whole / after[b[i]])
                    break
                out += np.log2(whole / len(after))
            else:
                out += 8
        return out

    some = plain[plain.text.notna() & (plain.text.str.len() < 3000)].head(25)
    model = langid.train(langid.learnable(docs), train_docs=10**9)
    assert model.languages == sorted(tables)
    lengths = model.code_lengths([t.encode().lower() for t in some.text])
    want = np.array([[bits(t, tables[k]) for k in model.languages] for t in some.text])
    assert np.allclose(lengths, want, rtol=1e-9)


def test_language_filter(spark, docs):
    model = langid.train(docs)
    rows = [(1, "的一是不了人我在有他这中大来上个国到说们" * 5, None), (2, "the and of that this", None), (3, None, "en"), (4, "123", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.keep_identified(df, model).collect()] == [2]
    assert langid.keep_identified(df, model, languages=["de"]).isEmpty()
    # copies that fill a label do not crowd its other texts out of the sample
    many = docs.where("lang = 'es'").select("text", "lang").unionByName(spark.range(3000).selectExpr("'copia' AS text", "'es' AS lang"))
    assert langid.train(many).trees[0].levels[0][2].sum() > 10_000


def test_escape_leaves_no_control_string():
    for n in range(7):
        for t in map("".join, itertools.product("<|>\\", repeat=n)):
            e = chat.escape(t)
            assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)
    for a, b in itertools.product(chat.CONTROL, repeat=2):
        for cut in range(len(b)):
            e = chat.escape(a + b[cut:])
            assert chat.unescape(e) == a + b[cut:] and not any(c in e for c in chat.CONTROL)


def test_expansion(spark):
    rng = random.Random(1)
    rows = [(c, k, rng.choice(["user", "assistant"]), rng.choice(["a", "<|>", "x" * 9, "", None])) for c in (1, 2, None) for k in range(12)]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = []
    for conv in (1, 2, 9, None):
        done = ""
        for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]):
            out, at, to = chat.render(r[2], r[3] or "")
            if r[2] == "assistant":
                want.append((conv, done + out, len(done) + at, len(done) + to))
            done += out
    got = [(r.conv_id, r.text, r.loss_from, r.loss_to) for r in chat.expand(chat.format_turns(df)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_scores_of_other_frames(spark, docs):
    bare = docs.where("length(text) < 5000")
    want = sorted(map(tuple, lm.score(bare).na.fill(-1).collect()), key=str)
    for other in (bare.repartition(7), bare.distinct(), bare.orderBy("n_chars"), bare.repartition(5).where("doc_id >= 0")):
        assert sorted(map(tuple, lm.score(other).na.fill(-1).collect()), key=str) == want


def test_licence_hits(spark):
    known = list(licenses.KNOWN)
    rows = [(k, "Copyright (c) 2024 A. Person\n\n" + t.upper().replace("\n", "\n\n  ").replace(",", " ;")) for k, (_, t) in enumerate(known)] * 2
    got = licenses.scan(spark.createDataFrame([*rows, (99, known[0][1] + " and more")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license_id) for r in got if r.doc_id < 99) == sorted([(k, n) for k, (n, _) in enumerate(known)] * 2)
    assert [r.license_id for r in got if r.doc_id == 99] == [None]


def test_full_licence_texts(spark, tmp_path):
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {n: (folder / f).read_text() for n, f in files.items() if (folder / f).is_file()}
    if not texts:
        pytest.skip("no licence texts on this machine")
    other = [re.sub(r"\blicense\b", "licence", t).replace("\n", "\r\n").replace(";", " ;").upper() for t in texts.values()]
    rows = [*enumerate(texts.values()), *enumerate(other), *((9, t[:-200]) for t in texts.values()), (9, None), (9, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entries.QUERIES["op8_licenses"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.license_id) for r in got if r.doc_id < 9) == sorted([*enumerate(texts)] * 2)
    assert {r.license_id for r in got if r.doc_id == 9} == {None}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entries.ORACLE_SQL["op8_licenses"]).df()
    key = lambda r: (r.doc_id, r.canonical_chars, r.digest, r.license_id if isinstance(r.license_id, str) else "")
    assert sorted(map(key, got)) == sorted(map(key, want.itertuples()))


def test_sieve_lets_every_key_through(spark):
    keys = spark.range(5000).selectExpr("id * 7919 AS h")
    test = sieve.sieve(keys, "h")
    assert keys.where(test(F.col("h"))).count() == 5000
    assert spark.range(1, 50_000).where(test(F.col("id") * 7919 + 1)).count() < 10_000
    assert sieve.sieve(keys.where("false"), "h") and keys.where(sieve.sieve(keys.where("false"), "h")(F.col("h"))).isEmpty()
    crowded = sieve.sieve(keys, "h", 15)
    assert keys.where(crowded(F.col("h"))).count() == 5000


def test_many_anchor_terms(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.contamination(docs, items).collect()), key=str)
    monkeypatch.setattr(decontaminate._listed, "__defaults__", (3,))
    monkeypatch.setattr(decontaminate.build_index, "__defaults__", (decontaminate.WINDOW, 3))
    assert sorted(map(tuple, decontaminate.contamination(docs, items).collect()), key=str) == want


def test_families_in_blocks(spark, docs):
    """Cells and families over their bounds are cut up and give the same links."""
    rows = similar.described(docs)
    sets = similar._whole_sets(docs, similar.partnered(docs, rows), similar.WORDS)
    one = {r.node: r.component for r in similar.connected_components(similar.similar_sets(sets)).collect()}
    cut = {r.node: r.component for r in similar.connected_components(similar.similar_sets(sets, cell=2, family=400)).collect()}
    assert one and one == cut


def test_one_row_of_each_class(spark):
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(7, near), (7, near + " end"), (7, near), (None, near + " other"), (None, "alone here"), (None, "alone here"), (8, None), (9, ""), (3, "x " * 40_000)]
    kept = [tuple(r) for r in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == 4 and sum(r[0] == 7 for r in kept) == 1 and (None, "alone here") in kept and (8, None) in kept


ODD = [(1, None, None), (2, "", "en"), (3, "the end of this and that, mail a@b.co", "en"), (3, "the end of this and that, mail a@b.co", "en"), (4, "word and that " * 20_000, "en"), (None, "of the and was in a null id", "en"), (None, "of the and was in a null id", "en"), (5, "... 123 ...", None)]
EXTRA = ["__id", "__h", "__t", "__n", "score", "lang_pred", "bits_per_byte", "id", "h", "node", "fp", "row", "k", "class", "term", "w"]


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, name, step):
    rows = [(*r, *(f"{c}{k}" for c in EXTRA)) for k, r in enumerate(ODD)]
    rows[3] = (*rows[3][:3], *rows[2][3:])  # a whole row that is repeated
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in EXTRA))
    out = step(spark, df, SMALL)
    assert step(spark, df.where("false"), SMALL).isEmpty()
    if name == "best-fit packing":
        assert out.select("doc_id").distinct().count() == 6
        return
    assert out.columns == df.columns
    mine = {r[1]: set() for r in rows}
    for r in rows:
        mine[r[1]].add(tuple(r[3:]))
    got = out.collect()
    texts = [r.text for r in got]
    if name != "PII":
        assert all(tuple(r[3:]) in mine[r.text] for r in got)  # extra columns come through as they were
    if name == "language ID":
        assert None not in texts and "... 123 ..." not in texts
    elif name == "SimHash near-dedup":
        assert sorted(map(str, texts)) == sorted(str(t) for t in {r[1] for r in rows if r[1] != ""})
    elif name == "PII":
        assert len(got) == len(rows) and "the end of this and that, mail [EMAIL]" in texts
    else:
        assert len(got) == len(rows)


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    for k, rows in enumerate(([], [(*r, "s", 3) for r in ODD])):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "a benchmark item")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns[:2] == ["doc_id", "piece"] and (out.count() > 0) == bool(rows)
