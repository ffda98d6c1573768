import random

import public_tokenizers
import tiktoken

import __spark_entry__
from evidelta.llm import tokens


def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.read_ranks(f.read()), special_tokens={})


def test_ids_of_odd_texts():
    r, want, got = random.Random(3), reference(), tokens.public("byte_bpe_50k")
    texts = ["aaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "  a \r\n\tb'll", "Straße § 12—“x” \U0001f600", "ab" * 20_000, " " * 5_000, " ​"]
    texts += ["".join(r.choice("abcdeth é中\U0001f600'!1\n") for _ in range(r.randrange(1, 300))) for _ in range(300)]
    texts += ["".join(r.choice("ab1 .'s\x1c\x1f\x0b\x00_\r\n\t~" + extra) for _ in range(60)) for _ in range(300) for extra in ("", "\x85\xa0\u2028\u200b²Ⅷ")]
    for t in texts:
        assert got.ids(t) == want.encode_ordinary(t), t[:50]
        for piece in map(str.encode, got.split(t)):
            if 0 < len(piece) <= tokens.SCANNED:
                assert got.queued(piece) == got.scanned(piece), piece


def test_every_document_has_its_ids(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " "), (4, "The court held.")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = __spark_entry__.queries()["p6_ids"](spark, str(tmp_path))
    assert found.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((x.doc_id, x.ids) for x in found.collect()) == [(1, []), (2, []), (3, reference().encode_ordinary(" ")), (4, reference().encode_ordinary("The court held."))]
