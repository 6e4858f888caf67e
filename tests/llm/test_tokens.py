from lodeline.llm.tokens import BYTE_BPE, FOLDER, _tokenizer, decoded, token_counts, token_ids

TEXTS = ["", None, "Hello  world\n\n x", "it's we'll 'S <|endoftext|>", "   ", "ÅÅ naı̈ve Ⅳ 𝒙𝒚 👩‍💻👍🏽​ a\x85b  c", "a" * 3000, "字" * 500 + " 12345 \r\n\t", "x " * 4000]


def test_ids_equal_the_tokenizer_and_come_back(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "clash"), (None, "one", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = token_ids(df)
    got = {r.doc_id: r.ids for r in out.collect()}
    t = _tokenizer(f"{FOLDER}/{BYTE_BPE}")
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in [*enumerate(TEXTS), (None, "one")]}
    assert got[0] == got[1] == [] and out.count() == len(TEXTS) + 1
    assert {r.doc_id: r.text for r in decoded(out).collect()} == {**{i: x or "" for i, x in enumerate(TEXTS)}, None: "one"}
    assert token_ids(df.limit(0)).count() == 0


def test_hot_words_of_any_length_and_counts(spark):
    """A rule of 400 dashes that is more than half of all words is spread, not sent to one task; counts are lengths of ids."""
    rule = "-" * 400
    rows = [(i, f"{rule} word{i}\n{rule}", "a") for i in range(300)] + [(1, f"{rule} word1\n{rule}", "a"), (900, None, None), (901, "", "b"), (None, "one", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    t = _tokenizer(f"{FOLDER}/{BYTE_BPE}")
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x, _ in rows}
    assert {r.doc_id: r.ids for r in token_ids(df).collect()} == want
    counts = token_counts(df).collect()
    assert len(counts) == len(want) and {r.doc_id: r.n_tokens for r in counts} == {i: len(x) for i, x in want.items()}
    assert token_counts(df.limit(0)).count() == 0
