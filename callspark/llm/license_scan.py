"""License scan by diagonal voting, in DataFrame operations only.

Method. Every rolling three-word gram of every text is joined with the grams of the templates (a broadcast of a
fixed, small table); a hit votes for the diagonal text position - template position. Votes are counted per
diagonal, and diagonals within ``GAP`` words are merged (insertions and deletions move the diagonal). A span of merged diagonals is
verified by the words at its grams and, from each of its places on, by the longest row of grams that stand in the text in
the template's order within ``STRETCH`` times the template's words.

A base phrase counts where all its words stand consecutively. A license is also reported where such a row has
``COVER`` of a template's grams or more; ``score`` is the largest share that any template reaches.

Cases: an empty table gives no rows. Licenses that tie are all reported. A null text has no words. Rows that repeat doc_id and text each get the same answer. Any text length works;
texts under three words have no gram. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Base phrases and their labels.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Opening words of published license texts and notices.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
GRAM = 3
GAP = 3
COVER = 0.6
STRETCH = 1.5
_BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_NO_GRAM = -1


def template_grams(spark: SparkSession) -> DataFrame:
    """(gram, template, label, base, at, size, w0, w1, w2): a row per gram, and one for the mark of a row itself."""
    rows = []
    for k, (label, text) in enumerate((*PHRASES, *TEMPLATES)):
        words = text.split()
        rows += [(k, label, k < len(PHRASES), at, len(words) - GRAM + 1, *words[at : at + GRAM]) for at in range(len(words) - GRAM + 1)]
    grams = spark.createDataFrame(rows, "template int, label string, base boolean, at int, size int, w0 string, w1 string, w2 string")
    mark = spark.createDataFrame([(-1, "", False, 0, 1, "", "", "")], grams.schema).withColumn("gram", F.lit(_NO_GRAM).cast("long"))
    return grams.withColumn("gram", F.xxhash64("w0", "w1", "w2")).unionByName(mark)


def _in_order(votes: DataFrame) -> DataFrame:
    """(doc_id, text_hash, template, label, share) of each span: its longest row of grams in order, of all windows that begin at a gram."""
    marks = votes.where("template >= 0").select("doc_id", "text_hash", "template", "label", "size", "span", "diagonal", F.explode("seen").alias("at"))
    marks = marks.withColumn("place", F.col("at") + F.col("diagonal"))
    longest = max(len(text.split()) for _, text in (*PHRASES, *TEMPLATES))
    after = Window.partitionBy("doc_id", "text_hash", "template", "span").orderBy("place").rangeBetween(0, int(STRETCH * longest))
    seen = marks.withColumn("window", F.collect_list(F.struct("place", (-F.col("at")).alias("back"))).over(after))
    # grams start so that the last one ends within the stretch; of grams at one place the later in the template comes first, so they can't follow each other
    ends = F.col("place") + F.floor(STRETCH * (F.col("size") + GRAM - 1)).cast("int") - GRAM
    window = F.array_sort(F.filter("window", lambda m: m["place"] <= ends))
    chain = F.aggregate(
        window,
        F.array_repeat(F.lit(0), F.col("size")),
        lambda best, m: F.transform(best, lambda v, i: F.when(i == -m["back"], F.greatest(v, 1 + F.coalesce(F.array_max(F.slice(best, F.lit(1), -m["back"])), F.lit(0)))).otherwise(v)),
        lambda best: F.array_max(best),
    )
    return seen.groupBy("doc_id", "text_hash", "template", "label", "span").agg(F.max(chain / F.col("size")).alias("share"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row per row of ``docs``."""
    # only these two letters beyond ASCII have a lower case with ASCII letters in it
    text = F.lower(F.replace(F.replace(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı")))
    split = F.split(text, _BREAKS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("text_hash"), split.alias("split"))
    lead = F.when(F.col("split")[0] == "", 1).otherwise(0)
    trail = F.when((F.size("split") > 1) & (F.element_at("split", -1) == ""), 1).otherwise(0)
    rows = rows.select("doc_id", "text_hash", "split", lead.alias("lead"), (F.size("split") - lead - trail).alias("n"))
    # i: index of a gram's first word in ``split``; -1 stands for the row itself
    grams = rows.select("*", F.explode(F.concat(F.array(F.lit(-1)), F.when(F.col("n") >= GRAM, F.sequence(F.col("lead"), F.col("lead") + F.col("n") - GRAM)).otherwise(F.array().cast("array<int>")))).alias("i"))
    word = [F.when(F.col("i") < 0, "").otherwise(F.get("split", F.col("i") + k)) for k in range(GRAM)]
    gram = F.when(F.col("i") < 0, F.lit(_NO_GRAM).cast("long")).otherwise(F.xxhash64(*(F.get("split", F.col("i") + k) for k in range(GRAM))))
    grams = grams.withColumn("gram", gram)
    template = template_grams(docs.sparkSession).hint("broadcast")
    hits = grams.join(template, (grams["gram"] == template["gram"]) & (word[0] == F.col("w0")) & (word[1] == F.col("w1")) & (word[2] == F.col("w2")))
    hits = hits.select("doc_id", "text_hash", "n", "template", "label", "base", "size", "at", F.when(F.col("template") >= 0, F.col("i") - F.col("lead") - F.col("at")).alias("diagonal"))
    # one exchange: all that follows is grouped within (doc_id, text_hash)
    hits = hits.repartition("doc_id", "text_hash")
    votes = hits.groupBy("doc_id", "text_hash", "template", "diagonal").agg(
        F.first("n").alias("n"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("size").alias("size"), F.collect_set("at").alias("seen"), F.count("*").alias("times")
    )
    line = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= GAP, 0).otherwise(1)
    labelled = votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.col("base") & (F.size("seen") == F.col("size"))
    spans = labelled.groupBy("doc_id", "text_hash", "template", "span").agg(
        F.first("n").alias("n"), F.first("label").alias("label"), F.first("size").alias("size"), F.max("times").alias("times"),
        F.count_if(whole).alias("places"), F.min(F.when(whole, F.col("diagonal"))).alias("first_word"), F.max(F.when(whole, F.col("diagonal"))).alias("last_word"),
    ).withColumn("share", F.lit(None).cast("double"))
    spans = spans.unionByName(_in_order(labelled), allowMissingColumns=True)
    real, share = F.col("template") >= 0, F.col("share")
    out = spans.groupBy("doc_id", "text_hash").agg(
        F.max("n").cast("long").alias("n_words"), F.max(F.when(~real, F.col("times"))).cast("int").alias("copies"), F.sum(F.when(real, F.coalesce("places", F.lit(0))).otherwise(0)).alias("n_base"),
        F.min("first_word").cast("long").alias("first_word"), F.max("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("places") > 0, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when((F.col("places") > 0) | (share >= COVER), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
    )
    return out.select(F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), *out.columns).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
