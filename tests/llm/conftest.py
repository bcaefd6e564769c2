import pytest

TOKENS = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empties, ties, repeats, a very long text, and columns whose names the operators use themselves."""
    base = " ".join(f"w{k}" for k in range(90))
    near = base.replace("w45", "x45")
    texts = [
        None, "", "   \n\t ", "a", "one two three", base, base, near, base + " tail of other words " + base, "Ünïcode ß é́ 😀 text 😀",
        "mail a.b@c-d.example.org or +1 (555) 555-0100, 10.0.0.255 and 4111 1111 1111 1111!", "na " * 3000, ("long text " + base + " ") * 60, "x\x01y  z", "a b   c",
    ]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), 1.5, "k", 7) for i, t in enumerate(texts)]
    rows += [(20, None, None, None, None, None, None, None), (21, "tie tie", "en", "s1", 7, 0.0, "", 0), (21, "tie tie", "en", "s1", 7, 0.0, "", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key double, digest string, size int").repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(3, 1, 0), (5, 1, 0), (11, 0, 0), (13, 0, 0), (10, 1, 1), (None, 1, 0), (9, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def made_documents(odd_documents):
    return [(r["doc_id"], r["text"] or "") for r in odd_documents.orderBy("doc_id").collect()]
