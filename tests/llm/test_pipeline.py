"""The pipeline's stages against brute-force versions, on a small corpus with planted cases, and on no rows."""

import collections
import re
import zlib

import pytest

import corpus_pipeline as c
from tests.llm.test_texts import brute_repeats, brute_secrets, prose, sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rows = [(k, f"{prose(k, 25)} {'vile' if k % 6 == 0 else 'mild'} {prose(500 + k, 12)}") for k in range(400)]
    base, passage = prose(2000, 90), prose(2001, 70)
    rows += [(1000 + k, base + " x" * (k % 3)) for k in range(6)] + [(1100 + k, f"{prose(2100 + k, 30)} {passage} {prose(2200 + k, 30)}") for k in range(4)]
    a, b = prose(3000, 60), prose(3001, 60)
    rows += [(1201, a), (1205, a), (1205, b), (1206, a + " more"), (1207, "same few words"), (1207, "same few  words"), (1207, "same few  words"), (None, a), (None, None), (1300, None), (1301, ""), (1302, " \n")]
    rows += [(1400, "bad \ufffd char"), (1401, f"\ufffd {prose(4000, 20)} token=abcdef12 and AKIA" + "B" * 20), (1402, "x" * 70 + " v1le")]
    return rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows (doc_id, text) before the first stage and after each of the first four."""
    folder = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in corpus()], SCHEMA)
    out = [docs]
    for _, stage in c.STAGES[:-1]:
        rows = stage(spark, out[-1], folder).collect()
        out.append(spark.createDataFrame([tuple(r) for r in rows], SCHEMA))
    return [[(r.doc_id, r.text) for r in df.collect()] for df in out]


def counted(rows):
    return collections.Counter(rows)


def test_toxic_documents_go(stages):
    # the corpus has one toxic word, and one disguise of it
    assert counted(stages[1]) == counted((d, t) for d, t in stages[0] if not re.search(r"vile|v1le", t or ""))


def test_one_of_each_group_stays(stages):
    rows = stages[1]
    s = sets(rows)
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    some = [i for i, (d, _) in enumerate(rows) if s[i] and d is not None]
    for i in some:
        for j in some:
            if j < i and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                up[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in some:
        groups[find(i)].append(i)
    got = collections.Counter(stages[2])
    for i, row in enumerate(rows):
        if i not in set(some):
            assert got[row] >= 1
            got[row] -= 1
    for members in groups.values():
        least = min(rows[i][0] for i in members)
        kept = [r for r in {rows[i] for i in members} if got[r] > 0]
        assert len(kept) == 1 and kept[0][0] == least and got[kept[0]] == 1
        got[kept[0]] -= 1
    assert not +got


def test_repeats_go(stages):
    got = {d: t for d, t in stages[3] if d is not None}
    want = {r[0]: r for r in brute_repeats(stages[2], 200)}
    for d, text in stages[2]:
        if d is None or want[d][2] == 0:
            assert (d, text) in stages[3]
        else:
            # texts of this corpus are ASCII where they are cut
            assert len(got[d].encode()) == want[d][1] - want[d][2]
    assert any(r[2] for r in want.values()) and len(stages[3]) == len(stages[2])


def test_secrets_are_masked(stages):
    before, after = collections.Counter(stages[3]), collections.Counter(stages[4])
    found = {r[0] for r in brute_secrets(stages[3]) if any(r[1:4])}
    assert found == {1401}
    assert {d for d, _ in (before - after)} == {1401}
    assert not any(any(r[1:4]) for r in brute_secrets(stages[4]))


def test_all_that_is_left_is_packed(spark, stages):
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in stages[4]], SCHEMA)
    got = c.packed(spark, docs, "").collect()
    assert counted(r.doc_id for r in got if r.piece == 0) == counted(d for d, _ in stages[4])
    empty = next(r for r in got if r.doc_id == 1301)
    assert (empty.length, empty.ids_crc32) == (1, zlib.crc32(bytes(4)))


@pytest.mark.parametrize("stage", c.STAGES, ids=lambda s: s[0])
def test_no_rows(spark, sf_dir, stage):
    none = spark.createDataFrame([], SCHEMA)
    out = stage[1](spark, none, sf_dir)
    assert out.count() == 0
    if stage is not c.STAGES[-1]:
        assert tuple(out.columns) == c.COLUMNS
