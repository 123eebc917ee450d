"""Freely written names mapped to the entries of a reference list.

Tokens are repaired first: each distinct token of the names meets the tokens
of the reference list by edit distance, through an equi-join on shared
deletion variants. The reference entries whose rarest word a token of the name may
stand for are then ranked by soft TF-IDF over all of the name's repaired tokens.
"""

from __future__ import annotations

import unicodedata
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillet.session import durable


def _letters() -> tuple[str, str]:
    """Accented letters and the plain ones they are written with, from their Unicode decompositions."""
    pairs = []
    for code in chain(range(0xC0, 0x250), range(0x1E00, 0x1F00), range(0xFF10, 0xFF5B)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if len(plain) == 1 and plain.isascii() and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _letters()


def plain(c: Column) -> Column:
    """Lower case without accents, combining marks and invisible characters. Texts whose characters are all one byte have none of them."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(F.regexp_replace(F.lower(c), r"[\p{Mn}\p{Cf}]", ""), ACCENTED, PLAIN))


def tokens_of(c: Column) -> Column:
    """The runs of letters of a text, in order; digits and signs separate them."""
    return F.filter(F.split(plain(c), r"[^\p{L}]+"), lambda t: t != "")


def deletions(c: Column, most: int) -> Column:
    """Distinct texts that ``c`` becomes by leaving out up to ``most`` characters, itself included."""
    drop = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    level, every = F.array(c), F.array(c)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, drop)))
        every = F.array_distinct(F.concat(every, level))
    return every


def skeleton(c: Column) -> Column:
    """A word without its vowels, but for the first letter: what is left of it in a shortened writing."""
    return F.concat(F.substring(c, 1, 1), F.regexp_replace(F.substring(c, F.lit(2), F.length(c)), "[aeiou]", ""))


def sound(c: Column, doubled: bool = False) -> Column:
    """A rough key of how a word sounds: one letter for common spellings of one sound and, unless ``doubled``, for doubled letters."""
    for pattern, to in (("ie$", "y"), ("ph", "f"), ("oo|ou", "u"), ("ea|ee", "i"), ("ck|c(?=[aoulr])|q", "k"), ("z|c(?=[eiy])", "s")):
        c = F.regexp_replace(c, pattern, to)
    return c if doubled else F.regexp_replace(c, r"(.)\1", "$1")


def allowed(length: Column) -> Column:
    """The number of edits taken for a misspelling of a word of that many letters."""
    return F.when(length <= 3, 0).when(length <= 5, 1).otherwise(2)


def variants(c: Column) -> Column:
    """``deletions`` of as many letters as a word of that length may have edits."""
    n = allowed(F.length(c))
    return F.when(n == 0, F.array(c)).when(n == 1, deletions(c, 1)).otherwise(deletions(c, 2))


def repairs(tokens: DataFrame, vocabulary: DataFrame, margin: float = 0.0, broadcast_limit: int = 20_000) -> DataFrame:
    """(token, words array<string>, sim): what each token can stand for in the vocabulary.

    ``tokens``: distinct ``token``; ``vocabulary``: distinct ``word``. A token stands for a word
    - that it equals (sim 1), also but for a plural s (0.98);
    - whose skeleton it is, but for one letter, or the opening three letters or more of it, if the token has no vowel but the first letter (0.9);
    - whose consonants it has in order, as they sound, but for two (0.85), if it has no vowel but the first letter;
    - that sounds alike (0.8);
    - within the allowed edits; a swap of two letters is one edit;
    - of which it is the opening three letters or more, but for a plural s (0.7);
    - or for two words written as one, each of which may hold an edit.
    Repairs within ``margin`` of the token's highest sim are kept.
    """
    # The reference list may be broadcast as far as a count allows; tables made of tokens grow with the names and are
    # never broadcast on an estimate, which knows nothing of how many rows explode makes.
    fits = vocabulary.limit(broadcast_limit + 1).count() <= broadcast_limit
    side = F.broadcast if fits else (lambda df: df.hint("merge"))
    words = vocabulary.select("word", F.length("word").alias("wl"))
    exact = tokens.join(side(words), F.col("token") == F.col("word")).select("token", F.array("word").alias("words"), F.lit(1.0).alias("sim"))
    # Of a single word.
    by = words.select("word", "wl", F.explode(variants(F.col("word"))).alias("v"))
    unknown = tokens.join(side(words), F.col("token") == F.col("word"), "left_anti")
    stem = F.regexp_replace("token", "s$", "")
    near = unknown.select("token", F.explode(F.array_union(variants(F.col("token")), variants(stem))).alias("v")).join(side(by), "v").select("token", "word", "wl").distinct()
    single = _edits(near, "token").select("token", F.array("word").alias("words"), "sim")
    short = unknown.where(~F.col("token").rlike("^.+[aeiou]") & (F.length("token") >= 3)).select("token", F.explode(F.array_distinct(F.array("token", F.regexp_replace("token", "s$", "")))).alias("k"))
    bones = words.select("word", F.explode(F.array_union(deletions(skeleton(F.col("word")), 1), F.array(F.regexp_replace(skeleton(F.col("word")), r"(.)\1", "$1")))).alias("b")).where("length(b) >= 4 or b = word or length(word) <= 4 and length(b) >= 3")
    bones = bones.select("word", F.explode(F.transform(F.sequence(F.lit(3), F.length("b")), lambda n: F.substring("b", F.lit(1), n))).alias("k")).distinct()
    bare = short.join(side(bones), "k").select("token", F.array("word").alias("words"), F.lit(0.9).alias("sim")).distinct()
    heard = words.select("word", F.explode(deletions(skeleton(sound(F.col("word"), True)), 2)).alias("k")).where(F.substring("k", 1, 1) == F.substring("word", 1, 1))
    short = short.where("length(k) >= 3").select("token", sound(F.col("k"), True).alias("k")).distinct()
    bare = bare.unionByName(short.join(side(heard), "k").select("token", F.array("word").alias("words"), F.lit(0.85).alias("sim")).distinct())
    alike = unknown.withColumn("k", sound(F.col("token"))).join(side(words.withColumn("k", sound(F.col("word")))), "k").select("token", F.array("word").alias("words"), F.lit(0.8).alias("sim"))
    heads = words.where("wl >= 5").select("word", F.explode(F.transform(F.sequence(F.lit(3), F.col("wl") - 1), lambda n: F.substring("word", F.lit(1), n))).alias("k"))
    heads = unknown.select("token", F.explode(F.array_distinct(F.array("token", F.regexp_replace("token", "s$", "")))).alias("k")).join(side(heads), "k").select("token", F.array("word").alias("words"), F.lit(0.7).alias("sim"))
    # Of two words in one.
    cuts = unknown.where(F.length("token") >= 7).select("token", F.explode(F.sequence(F.lit(3), F.length("token") - 3)).alias("at"))
    cuts = cuts.select("token", F.substring("token", F.lit(1), F.col("at")).alias("a"), F.substring("token", F.col("at") + 1, F.length("token")).alias("b"))
    halves = cuts.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    known = halves.join(side(words), F.col("h") == F.col("word")).select("h", "word", F.lit(1.0).alias("sim"))
    by1 = words.select("word", "wl", F.explode(deletions(F.col("word"), 1)).alias("v"))
    # One half must be a word as it stands; only then is the other one looked up by edits.
    exact_a = cuts.join(known.select(F.col("h").alias("a"), F.col("word").alias("wa"), F.col("sim").alias("sa")).hint("merge"), "a")
    exact_b = cuts.join(known.select(F.col("h").alias("b"), F.col("word").alias("wb"), F.col("sim").alias("sb")).hint("merge"), "b")
    rest = exact_a.select(F.col("b").alias("h")).union(exact_b.select(F.col("a").alias("h"))).distinct().where("length(h) >= 4")
    fuzzy = rest.select("h", F.explode(deletions(F.col("h"), 1)).alias("v")).join(side(by1), "v").select("h", "word", "wl").distinct()
    fuzzy = _edits(fuzzy, "h", most=1).select("h", "word", "sim").unionByName(known)
    first = exact_a.join(fuzzy.select(F.col("h").alias("b"), F.col("word").alias("wb"), F.col("sim").alias("sb")).hint("merge"), "b").select("token", "wa", "wb", "sa", "sb")
    second = exact_b.join(fuzzy.select(F.col("h").alias("a"), F.col("word").alias("wa"), F.col("sim").alias("sa")).hint("merge"), "a").select("token", "wa", "wb", "sa", "sb")
    double = first.unionByName(second).select("token", F.array("wa", "wb").alias("words"), (F.col("sa") * F.col("sb") * 0.95).alias("sim")).distinct()
    every = exact.unionByName(single).unionByName(bare).unionByName(alike).unionByName(heads).unionByName(double)
    best = F.max("sim").over(Window.partitionBy("token"))
    return every.withColumn("_best", best).where(F.col("sim") >= F.col("_best") - margin - 1e-9).groupBy("token", "words").agg(F.max("sim").alias("sim"))


def _edits(pairs: DataFrame, token: str, most: int = 2, plural: bool = True) -> DataFrame:
    """``pairs`` (token, word, wl) within the allowed edits, with ``sim``. A closing s and swapped neighbours cost little."""
    t, w = F.col(token), F.col("word")
    exact = F.levenshtein(t, w).cast("double")
    d = exact if not plural else F.least(exact, F.when(t.endswith("s"), F.levenshtein(F.regexp_replace(t, "s$", ""), w) + 0.15), F.when(t.endswith("es"), F.levenshtein(F.regexp_replace(t, "es$", ""), w) + 0.15), F.when(w.endswith("s"), F.levenshtein(t, F.regexp_replace(w, "s$", "")) + 0.15))
    swapped = (F.length(t) == F.length(w)) & (F.levenshtein(t, w) == 2) & (F.array_sort(F.split(t, "")) == F.array_sort(F.split(w, "")))
    d = F.when(swapped, F.lit(1.0)).otherwise(d)
    limit = F.least(allowed(F.least(F.length(t), F.col("wl"))), F.lit(most))
    return pairs.withColumn("_d", d).where(F.col("_d") < limit + 0.5).withColumn("sim", 1.0 - F.col("_d") / F.greatest(F.length(t), F.col("wl")))


def own_words(counts: DataFrame, table: DataFrame, ratio: float = 1.0, prior: float = 2.0) -> DataFrame:
    """Tokens (``token``, ``df``) that are words in their own right and no misspellings of a reference word.

    A misspelling is rarer than its word: a token whose repairs all have a sim below 0.9 is one of its own if more than
    ``ratio`` times as many names hold it as hold the words it could stand for, ``prior`` names being added to those. Tokens without any repair
    are words of their own as well. The rule compares numbers of the same names, so it holds alike at any number of them.
    """
    seen = counts.withColumnRenamed("token", "word").withColumnRenamed("df", "wdf")
    likely = table.select("token", "sim", F.explode("words").alias("word")).join(seen, "word", "left")
    likely = likely.groupBy("token").agg(F.max("sim").alias("sim"), F.coalesce(F.max("wdf"), F.lit(0)).alias("wdf"))
    rows = counts.join(likely, "token", "left")
    return rows.where(F.col("sim").isNull() | (F.col("sim") < 0.9) & (F.col("df") > ratio * (F.col("wdf") + prior))).select("token", "df")


def map_names(names: DataFrame, name: str, reference: DataFrame, key: str, entry: str, margin: float = 0.1, vague: float = 0.8) -> DataFrame:
    """(name, key, score): per distinct name the entry it names, with its soft TF-IDF; key is null where it names none.

    Each token of a name is repaired to words of the reference list. An entry's score is the cosine of the idf-weighted
    word vectors of entry and name, each shared word counting by the similarity of the token that stands for it (soft
    TF-IDF). Candidates are the entries whose rarest word some token may stand for; an entry of which all words are
    said is among them, and each entry meets a name once. They are ranked by score, the smaller key as text first on a tie, and the first that
    is complete is taken: all of its words are said, and all known tokens say one of them. The first token may stay out if its best repair is
    below ``vague``: it may be a brand that only resembles a word.

    Accents, case, order, repeated words, plural s, joined words, brackets, misspellings and words that no entry has (brands, remarks) don't
    matter. Null names are left out; an empty name names nothing. Null keys and empty entries aren't mapped to.
    """
    words = F.array_distinct(tokens_of(F.col(entry)))
    entries = durable(reference.select(F.col(key).cast("string").alias("_key"), words.alias("_w")).where("_key is not null and size(_w) > 0"))
    n_entries = entries.count()
    vocabulary = durable(entries.select(F.explode("_w").alias("word")).groupBy("word").agg(F.log(F.lit(1.0) + F.lit(float(n_entries)) / F.count("*")).alias("idf")))
    distinct = names.select(F.col(name).alias("_name")).where("_name is not null").distinct()
    strings = distinct.select("_name", F.posexplode(tokens_of(F.col("_name"))).alias("_pos", "token"))
    counts = durable(strings.groupBy("token").agg(F.countDistinct("_name").alias("df")))
    table = durable(repairs(counts.select("token"), vocabulary.select("word"), margin))
    own = durable(own_words(counts, table))
    table = table.join(own.select("token").hint("merge"), "token", "left_anti")
    # A token that comes closer to a more frequent word of its own than to any word of the list is a misspelling of that.
    best = table.groupBy("token").agg(F.max("sim").alias("best")).where("best < 0.98").join(counts, "token")
    forms = own.select(F.col("token").alias("word"), F.col("df").alias("odf"), F.length("token").alias("wl"), F.explode(variants(F.col("token"))).alias("v"))
    near = best.select("token", "best", "df", F.explode(variants(F.col("token"))).alias("v")).join(forms.hint("merge"), "v").where("odf > 2 * df").select("token", "best", "word", "wl").distinct()
    other = _edits(near, "token", plural=False).where("sim > best").select("token").distinct()
    table = table.join(other.hint("merge"), "token", "left_anti")
    # Soft TF-IDF over the candidates.
    first, second = F.element_at("words", 1), F.try_element_at("words", F.lit(2))
    weighed = table.join(vocabulary.select(F.col("word").alias("_a"), F.col("idf").alias("_ia")).hint("merge"), first == F.col("_a"))
    weighed = weighed.join(vocabulary.select(F.col("word").alias("_b"), F.col("idf").alias("_ib")).hint("merge"), second == F.col("_b"), "left")
    choices = weighed.groupBy("token").agg(F.max("sim").alias("top"), F.collect_list(F.struct("words", "sim", F.greatest("_ia", F.coalesce("_ib", F.lit(0.0))).alias("idf"))).alias("choices"))
    choices = choices.withColumn("weight", F.array_min(F.transform("choices", lambda c: c["idf"])))
    spread = strings.groupBy("_name", "token").agg(F.min("_pos").alias("_pos"))
    # A token may stand in any share of the names: the at most hundred that make up a hundredth of all tokens each are broadcast, so that none gathers in one task.
    every_token = counts.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.where(F.col("df") * 100 >= every_token).select("token"))
    placed = spread.join(F.broadcast(choices.join(hot, "token", "left_semi")), "token")
    placed = placed.unionByName(spread.join(hot, "token", "left_anti").join(choices.join(hot, "token", "left_anti").hint("merge"), "token"))
    heads = F.min("_pos").over(Window.partitionBy("_name"))
    placed = placed.withColumn("free", (F.col("_pos") == heads) & (F.col("top") < vague))
    per_name = placed.groupBy("_name").agg(F.collect_list(F.struct("choices", "free", "weight")).alias("_t"))
    every = F.array_distinct(F.flatten(F.flatten(F.transform("_t", lambda t: F.transform(t["choices"], lambda c: c["words"])))))
    asked = per_name.select("_name", "_t", F.explode(F.array(every)).alias("_every")).select("_name", "_t", "_every", F.explode("_every").alias("word"))
    listed = entries.select("_key", "_w", F.explode("_w").alias("word")).join(vocabulary, "word").groupBy("_key", "_w")
    listed = listed.agg(F.collect_list(F.struct("word", "idf")).alias("_e"), F.sum(F.col("idf") * F.col("idf")).alias("_norm"), F.max(F.struct("idf", "word")).alias("_rarest")).withColumn("word", F.col("_rarest.word")).drop("_rarest")
    fits = listed.limit(200_001).count() <= 200_000
    # An entry that says a word which no token can stand for isn't complete.
    pairs = asked.join(F.broadcast(listed) if fits else listed.hint("merge"), "word").where((F.size("_w") <= F.size("_every")) & (F.size(F.array_except("_w", "_every")) == 0))
    said = F.transform("_t", lambda t: F.struct(t["free"].alias("free"), t["weight"].alias("weight"), F.array_max(F.transform(F.filter(t["choices"], lambda c: F.size(F.array_except(c["words"], F.col("_w"))) == 0), lambda c: F.struct(c["sim"].alias("sim"), c["words"].alias("words")))).alias("as")))
    # The array keeps the optimizer from working it out again for every use.
    pairs = pairs.select("_name", "_key", "_w", "_e", "_norm", F.explode(F.array(said)).alias("_s"))
    for_word = lambda w: F.coalesce(F.array_max(F.transform(F.filter("_s", lambda x: F.array_contains(x["as"]["words"], w["word"])), lambda x: x["as"]["sim"])), F.lit(0.0))
    pairs = pairs.select("_name", "_key", "_norm", F.explode(F.array(F.transform("_e", lambda w: F.struct(w["idf"].alias("idf"), for_word(w).alias("sim"))))).alias("_m"), F.filter("_s", lambda x: x["as"].isNull()).alias("_left"))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))
    dot = total("_m", lambda x: x["idf"] * x["idf"] * x["sim"])
    norm = total("_m", lambda x: F.when(x["sim"] > 0, x["idf"] * x["idf"]).otherwise(0.0)) + total("_left", lambda x: x["weight"] * x["weight"])
    complete = ~F.exists("_m", lambda x: x["sim"] <= 0) & ~F.exists("_left", lambda x: ~x["free"])
    scored = pairs.select("_name", "_key", F.try_divide(dot, F.sqrt(norm * F.col("_norm"))).alias("score"), complete.alias("_whole")).where("_whole")
    taken = scored.groupBy("_name").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("_key").alias("k"))).alias("m"))
    return distinct.join(taken, "_name", "left").select(F.col("_name").alias(name), F.col("m.k").alias(key), (-F.col("m.s")).alias("score"))
