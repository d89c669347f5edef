"""Token counts that are revised, moved, and kept for two tokenizer versions."""

from tracklens.llm import queries, rollups


def test_two_versions(spark, monkeypatch):
    import public_tokenizers

    batches = {}
    commit = rollups.Rollup.commit

    def watched(self, batch, change):
        batches[batch] = [tuple(r) for r in change.collect()]
        return commit(self, batch, change)

    monkeypatch.setattr(rollups.Rollup, "commit", watched)
    got = sorted(map(tuple, queries.op7_token_counts(spark, "/root/testdata/sf0.001").collect()), key=repr)
    docs, wanted = queries.table(spark, "/root/testdata/sf0.001", "documents"), {}
    for ranks, name in (("byte_bpe_50k", "byte_bpe_50k"), ("byte_bpe_multi_50k", "byte_bpe_50k-revised")):
        for r in rollups.token_counts(docs, public_tokenizers.path(f"{ranks}.tiktoken"), name).collect():
            a, b, c = wanted.get((r.source, r.lang, name), (0, 0, 0))
            wanted[(r.source, r.lang, name)] = (a + 1, b + r.tokens, c + r.chars)
    assert got == sorted(((*k, *v) for k, v in wanted.items()), key=repr)
    change = batches["revisions"]
    assert any(r[3] < 0 for r in change) and any(r[3] > 0 for r in change) and sum(r[3] for r in change) == 0 < sum(r[4] for r in change)
