"""Roles of chats, and documents with columns that clash or have no order."""

from pyspark.sql import functions as F

from arborist.llm import chat, decontaminate, neardup

PASSAGE = " ".join(f"word{k}" for k in range(40))


def test_a_role_holds_for_its_turn_only(spark):
    rows = [(1, 0, "message", 0, "user", "hi"), (2, 0, "regenerate", 0, None, None), (2, 1, "delta", 0, None, "new"), (3, 0, "message", 0, "assistant", "a"), (3, 1, "regenerate", 0, None, None), (3, 2, "delta", 0, None, "b"), (3, 3, "regenerate", 1, None, None), (3, 4, "delta", 1, None, "c")]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string").coalesce(1)
    out = [(r["conv_id"], *chat.parse(r["rendered"])) for r in chat.format_chats(events).orderBy("conv_id", "ord").collect()]
    assert [x for x in out if x[0] != 3] == [(1, "user", "hi"), (2, "", "new")]
    assert [x[1:] for x in out if x[0] == 3][-1] == ("", "c")


def test_clean_documents_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, PASSAGE, "a", 5, {"k": 1}), (2, "short and clean text of its own", "b", 6, {"k": 2}), (2, None, None, None, None)], "doc_id long, text string, `_key` string, key long, row map<string, int>")
    bench = spark.createDataFrame([(9, PASSAGE)], "item_id long, text string")
    out = decontaminate.drop_contaminated(docs, bench)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["_key"] or "", r["key"] or 0, r["row"] or {}) for r in out.collect()) == [(2, "", 0, {}), (2, "b", 6, {"k": 2})]


def test_rows_of_one_id_with_maps(spark):
    docs = spark.createDataFrame([(1, PASSAGE, {"k": 2}), (1, PASSAGE, {"k": 1}), (2, "another text that is long enough", None)], "doc_id long, text string, extra map<string, int>")
    out = neardup.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["extra"]) for r in out.select("doc_id", F.col("extra.k").alias("extra")).na.fill(0).collect()) == [(1, 1), (2, 0)]
