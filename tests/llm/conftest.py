import pytest

VOCABULARY = "byte_bpe_50k.json"


@pytest.fixture(scope="session")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return str(public.path(VOCABULARY))


@pytest.fixture(scope="session")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


LONG = "ab" * 40_000 + " " * 3_000 + "the end"
ODD = [None, "", "   \n\t", "a", "Hello WORLD, hello world.", "<|endoftext|>x<|endoftext|>", "naïve élève ßüß 漢字 \U0001f600 ​ x", "0123 456", LONG, "twice the same", "twice the same"]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, very long and repeated texts, a null id, null labels, and columns that clash with the operators' own."""
    rows = [(None if k == 3 else k, t, "en" if k % 2 else None, "s" if k % 3 else None, len(t or ""), k, "x", 1.0) for k, t in enumerate(ODD)]
    rows += [rows[4], (4, "another text of the same id", "en", "s", 1, 0, "y", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, score double")
