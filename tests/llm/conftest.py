import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD_TEXTS = [None, "", " \n\t", "one", "two words", "Don't STOP, it's 12,345.67 (ok)", "été ÉTÉ. ÜBER!", "日本語、テスト。", "a\x0bb\x1fc \x85 e\xa0f", "same text here now", "same text here now", "x" * 3000, "<|endoftext|> <unk> ▁ a▁b", "é \U0001d54f"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, long, odd and equal texts, repeated rows, a null id, and extra columns of clashing names."""
    rows = [(i * 3, t, "en", f"s{i % 3}" if i % 5 else None, 0, i, "x") for i, t in enumerate(ODD_TEXTS)]
    rows += [(9, "two words", "en", "s0", 0, 1, "x"), (9, "two words", "en", "s0", 0, 1, "x"), (None, "no id at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, score string")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
