"""The corpus pipeline: each stage against brute force on its own input, and the registered queries' contract columns."""

import random
import re
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
from test_operators import hits_of, plain_verdict

import corpus_pipeline
from lumenlake.llm import packing, probminhash, tokens
from lumenlake.llm.common import materialise
from lumenlake.llm.queries import ORACLES, QUERIES


VOCABULARY = """river house light morning window garden paper mountain winter summer letter table kitchen market bridge
village forest ocean teacher doctor farmer writer singer painter engine signal record number reason answer question
memory language history science music picture story journey harbour island valley castle street corner shoulder finger
travel carry follow gather listen measure prepare remember imagine discover consider deliver promise return wonder
quiet narrow ancient modern gentle bitter golden silver broken hidden distant clever honest heavy simple sudden""".split()


def fixture(folder):
    """Documents with copies, noise, passages of the benchmark, personal data and odd rows; (id, text, lang) and items."""
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    items = [(i, prose(rng.choice([13, 20, 40]))) for i in range(6)] + [(7, None), (8, "")]
    rows = [(i, prose(rng.randint(60, 140)), "en") for i in range(20)]
    near = rows[3][1].split()
    near[30] = "another"
    rows += [(30, " ".join(near), "en"), (31, rows[4][1], "en"), (31, rows[4][1], "en"), (4, rows[4][1], "en"), (32, rows[4][1], None)]
    rows += [(40, None, None), (41, "", "en"), (None, None, "en"), (42, "short text", "en"), (43, "word " * 200, "en"), (44, " ".join("".join(rng.choice("qxzjkvwbp") for _ in range(7)) for _ in range(90)), "en")]
    rows += [(50 + i, f"{prose(30)} {items[i][1]} {prose(30)}", "en") for i in range(4)] + [(60, f"{prose(900)} {items[0][1]}", "en"), (None, prose(80), "en")]
    rows += [(70, f"{prose(40)} write to jane [at] mail [dot] org or a.b@c.de {prose(40)}", "en"), (71, f"{prose(60)} call +49 170 1234567 or 4111 1111 1111 1111 at 10.0.0.1", "en"), (72, prose(20_000), "en")]
    docs = [(d, t, g, "src", len(t or ""), "x") for d, t, g in rows]
    table = lambda names, kinds, values: pa.table({n: pa.array([v[i] for v in values], k) for i, (n, k) in enumerate(zip(names, kinds))})
    pq.write_table(table(["doc_id", "text", "lang", "source", "n_chars", "node"], [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()], docs), folder / "documents.parquet")
    pq.write_table(table(["item_id", "text"], [pa.int64(), pa.string()], items), folder / "benchmark.parquet")
    return rows, items


def test_each_stage_matches_brute_force(spark, tmp_path):
    rows, items = fixture(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, stages = docs.columns, dict(corpus_pipeline.STAGES)
    step = lambda name: materialise(stages[name](spark, docs, str(tmp_path)), name)[0]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    read = lambda: sorted(((r.doc_id, r.text) for r in docs.collect()), key=key)

    docs = step("quality")
    want = sorted(((d, t) for d, t, g in rows if plain_verdict(t, g)[3]), key=key)
    assert docs.columns == names and read() == want and 0 < len(want) < len(rows)

    docs = step("near_duplicates")
    sets, up = [probminhash.weighted_set(t) for _, t in want], list(range(len(want)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(want)):
        for j in range(i):
            if want[i][1] == want[j][1] or max(probminhash.similarity(sets[i], sets[j])) >= 0.8:
                a, b = sorted((root(i), root(j)))
                up[b] = a  # rows are sorted, so the least is the one of the least id
    want = [want[i] for i in range(len(want)) if root(i) == i]
    assert docs.columns == names and read() == want

    docs = step("decontamination")
    found = {(d, t): hits_of(t, items) for d, t in want}
    want = [x for x in want if not (found[x][1] and 20 * found[x][1] >= found[x][0])]
    assert docs.columns == names and read() == want and 60 in {d for d, _ in want} and not {50, 51, 52, 53} & {d for d, _ in want}

    docs = step("personal_data")
    hidden = {"jane [at] mail [dot] org": "<EMAIL>", "a.b@c.de": "<EMAIL>", "+49 170 1234567": "<PHONE>", "4111 1111 1111 1111": "<CARD>", "10.0.0.1": "<IP>"}
    for old, new in hidden.items():
        want = [(d, t.replace(old, new)) for d, t in want]
    assert docs.columns == names and read() == sorted(want, key=key) and all(r.n_chars == len(r.text) for r in docs.collect())

    packed = stages["packed"](spark, docs, str(tmp_path)).collect()
    enc, pieces, fill = tokens.encoder(), {}, {}
    for r in packed:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, t in want:
        ids = enc.encode(t) + bytes(4)
        own = sorted(x for x in pieces[d] if zlib.crc32(ids[4 * x[0] : 4 * (x[0] + x[1])]) == x[2])
        assert sum(n for _, n, _ in own) == len(ids) // 4 and all(n == 2048 for _, n, _ in own[1:])
    for spans in fill.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in packed)
    assert len(fill) == packing.lower_bound([r.length for r in packed], 2048) >= total / 2048


def test_stages_of_an_empty_table(spark, tmp_path):
    fixture(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_run_is_the_stages_in_a_row(spark, data):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, data).count() > 0


COLUMNS = {
    "op3_winnowing": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op4_fertility": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_sstable": "doc_id start n_tokens ids_crc32",
    "op6_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op7_host_reputation": "page_id host path rule verdict",
    "op8_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9_probminhash": "doc_id class_id",
    "op10_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op11_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op12_blob_ledger": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op13_cross_tokenizer": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


def test_contract_columns(spark, data):
    assert {re.match(r"op(\d+)_", n)[1] for n in QUERIES} == {str(i) for i in range(1, 14)} and set(ORACLES) <= set(QUERIES)
    for name, wanted in COLUMNS.items():
        assert set(wanted.split()) <= set(QUERIES[name](spark, data).columns)


def test_oracles(spark, data):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, data)
        rel = con.sql(sql)
        cols = sorted(df.columns)
        at = [rel.columns.index(c) for c in cols]
        assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in rel.fetchall()))), name
