import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `key` int, part int, _row int"


@pytest.fixture(scope="session")
def texts():
    """Distinct texts: prose, blanks, repeats, junk, signs, other alphabets, and a long one."""
    base = [f"w{i} the cat number {i * 7 % 13} sat on a mat and looked at {i} birds " * (2 + i % 4) for i in range(30)]
    odd = [None, "", "   \n\t ", "one", "two words", "a b c d e", "# $ % & * | < >", "x " * 60, "Straße ÀÉÎ ñandú ça va", "日本語 テキスト\nзаметка", "I ’ve 12³ been <|endoftext|> here", "line\nline\nline\nother\n line"]
    long = " ".join(f"tok{i % 997}" for i in range(30_000))
    near = [base[3] + " tail", base[3] + " tail end", base[3].upper()]
    return base + odd + [long] + near + base[:5]


@pytest.fixture(scope="session")
def rows(texts):
    out = [(i, t, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4], None if t is None else len(t), "clash", 1, 2, 3) for i, t in enumerate(texts)]
    return out + [out[2], (None, "a row without an id " * 10, "en", "a", 0, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, DOC_SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
