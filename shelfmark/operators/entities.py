"""Entity names in file names and texts, and upkeep of the alias store."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.session import materialize, spread


def _usable(aliases: DataFrame) -> DataFrame:
    """Aliases of blanks name nothing and are left out."""
    return aliases.filter(F.trim("alias") != "")


def _anchored(aliases: DataFrame) -> DataFrame:
    """Aliases with ``w``, the word that the fewest aliases share (longest on ties)."""
    words = aliases.select("alias", F.explode(F.array_distinct(X.words(F.col("alias")))).alias("w"))
    shared = words.groupBy("w").agg(F.count(F.lit(1)).alias("uses"))
    rare = (
        words.join(shared, "w")
        .groupBy("alias")
        .agg(F.min(F.struct("uses", (-F.length("w")).alias("len"), "w"))["w"].alias("w"))
    )
    return aliases.join(rare, "alias", "left")


def match_substrings(
    files: DataFrame, text_col: str, aliases: DataFrame, key: str, out: str = "entity"
) -> DataFrame:
    """First alias in store order that is a substring of the lower-cased text.

    ``aliases``: (alias, canonical, ord), aliases lower-cased and unique; those
    of blanks alone are ignored. Adds ``out`` (NULL when nothing matches).

    An alias inside a text has each of its words inside one word of that text.
    Distinct words of the texts are cut into their substrings of the lengths
    in use, and these meet, as whole words, the alias word that the fewest
    aliases share: a match needs no further test. For aliases of one word only
    the best per text word is kept, so a text word brings one row however many
    aliases it holds. Aliases of several words are confirmed on the text.
    """
    store = materialize(_anchored(_usable(aliases)), "store")
    anchors = store.filter(F.col("w").isNotNull()).select("alias", "canonical", "ord", "w")
    # their number is bounded by the longest alias
    sizes = sorted(r[0] for r in anchors.select(F.length("w")).distinct().collect())
    tokens = files.select(key, F.explode(F.array_distinct(X.words(F.lower(text_col)))).alias("word"))
    vocabulary = spread(materialize(tokens.select("word").distinct(), "vocabulary"), "word")
    known = F.array(*[F.lit(n) for n in sizes]).cast("array<int>")
    cuts = F.flatten(
        F.transform(
            F.filter(known, lambda n: n <= F.length("word")),
            lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.col("word").substr(i, n)),
        )
    )
    hits = materialize(
        vocabulary.select("word", F.explode(F.array_distinct(cuts)).alias("w"))
        .join(anchors, "w")
        .select("word", "alias", "canonical", "ord"),
        "word_hits",
    )
    is_single = ~F.col("alias").rlike(r"\s")
    best_of_word = hits.filter(is_single).groupBy("word").agg(F.min(F.struct("ord", "canonical")).alias("hit"))
    single = tokens.join(best_of_word, "word").select(key, "hit")
    spaced = hits.filter(~is_single).select("word", "alias", "canonical", "ord")
    several = (
        tokens.join(spaced, "word")
        .select(key, "alias", "canonical", "ord")
        .dropDuplicates([key, "alias"])
        .join(files.select(key, F.lower(text_col).alias("_low")), key)
        .filter(F.contains("_low", F.col("alias")))
        .select(key, F.struct("ord", "canonical").alias("hit"))
    )
    best = single.unionByName(several).groupBy(key).agg(F.min("hit")["canonical"].alias(out))
    return files.join(best, key, "left")


def _pieces(alias_len: Column, word_len: Column) -> Column:
    """Indel distance bound of a ratio of at least 80, plus one."""
    return F.floor((alias_len + word_len) / F.lit(5)).cast("int") + 1


def _letters_suffice(a: Column, b: Column, threshold: int) -> Column:
    """Cheap upper bound: a common subsequence uses letters that both words have."""
    drop = lambda x, letters: F.length(F.call_function("translate", x, letters, F.lit("")))
    common = F.least(F.length(a) - drop(a, b), F.length(b) - drop(b, a))
    return common * 200 >= (F.length(a) + F.length(b)) * threshold


def _band(word_len: Column, alias_len: Column) -> Column:
    """Lengths that can still reach ratio 80: neither is over 3/2 of the other."""
    return (word_len * 3 >= alias_len * 2) & (alias_len * 3 >= word_len * 2)


def _piece_pairs(vocabulary: DataFrame, aliases: DataFrame, threshold: int) -> DataFrame:
    """Likely (word, alias) pairs for a store of any size, by an equi-join.

    At ratio 80 the insert/delete distance is at most a fifth of the summed
    lengths. Cutting the alias into one piece more than that distance leaves a
    piece intact in the word, near its own place. The pieces are the join key,
    so only likely pairs are scored and none is missed.
    """
    lo = lambda n: F.ceil(n * F.lit(2) / F.lit(3)).cast("int")
    hi = lambda n: F.floor(n * F.lit(3) / F.lit(2)).cast("int")
    # distinct lengths, not aliases: the longest alias bounds their number
    lengths = [r[0] for r in aliases.select(F.length("alias").alias("la")).distinct().filter("la > 0").collect()]
    known = F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>")

    pieces = (
        aliases.select("alias", "canonical", "ord", F.length("alias").alias("la"))
        .filter("la > 0")
        .withColumn("m", F.explode(F.sequence(lo(F.col("la")), hi(F.col("la")))))
        .withColumn("k", _pieces(F.col("la"), F.col("m")))
        .filter("k <= la")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumn("s", F.floor(F.col("i") * F.col("la") / F.col("k")).cast("int"))
        .withColumn("e", F.floor((F.col("i") + 1) * F.col("la") / F.col("k")).cast("int"))
        .select(
            "alias", "canonical", "ord", "la", "m", "i",
            F.substring(F.col("alias"), F.col("s") + 1, F.col("e") - F.col("s")).alias("piece"),
        )
    )
    # written, so that its true size decides between broadcast and shuffle
    pieces = materialize(pieces, "pieces")
    words = (
        vocabulary.select("word", F.length("word").alias("m"))
        .withColumn("la", F.explode(F.filter(known, lambda la: _band(F.col("m"), la))))
        .withColumn("k", _pieces(F.col("la"), F.col("m")))
        .filter("k <= la")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumn("s", F.floor(F.col("i") * F.col("la") / F.col("k")).cast("int"))
        .withColumn("len", F.floor((F.col("i") + 1) * F.col("la") / F.col("k")).cast("int") - F.col("s"))
        .withColumn("from", F.greatest(F.lit(0), F.col("s") - F.col("k") + 1))
        .withColumn("to", F.least(F.col("m") - F.col("len"), F.col("s") + F.col("k") - 1))
        .filter(F.col("from") <= F.col("to"))
        .withColumn("p", F.explode(F.sequence(F.col("from"), F.col("to"))))
        .select("word", "la", "m", "i", F.substring(F.col("word"), F.col("p") + 1, F.col("len")).alias("piece"))
    )
    return (
        words.join(pieces, ["la", "m", "i", "piece"])
        .filter(_letters_suffice(F.col("word"), F.col("alias"), threshold))
        .select("word", "alias", "canonical", "ord")
        .dropDuplicates(["word", "alias"])
    )


def fuzzy_word_matches(vocabulary: DataFrame, aliases: DataFrame, threshold: int = 80) -> DataFrame:
    """(word, canonical, ratio): best alias per word with indel ratio >= ``threshold``; one way for stores of any size."""
    if threshold < 80:
        raise ValueError("candidate pairs are complete for thresholds of 80 and above")
    return (
        _piece_pairs(vocabulary, _usable(aliases), threshold)
        .withColumn("ratio", X.indel_ratio(F.col("word"), F.col("alias")))
        .filter(F.col("ratio") >= threshold)
        .groupBy("word")
        .agg(F.min(F.struct((-F.col("ratio")).alias("worst"), "ord", "canonical", "ratio")).alias("hit"))
        .select("word", "hit.canonical", "hit.ratio")
    )


def match_fuzzy(
    files: DataFrame, text_col: str, aliases: DataFrame, key: str, threshold: int = 80
) -> DataFrame:
    """(key, word, entity, ratio): first word in text order with a good alias.

    Words under three letters are passed over. Scoring runs once per distinct
    word, not once per occurrence.
    """
    words = F.filter(X.words(F.lower(text_col)), lambda w: F.length(w) >= 3)
    placed = files.select(key, F.posexplode(words).alias("pos", "word"))
    vocabulary = spread(materialize(placed.select("word").distinct(), "vocabulary"), "word")
    hits = fuzzy_word_matches(vocabulary, aliases, threshold)
    return (
        placed.join(hits, "word")
        .groupBy(key)
        .agg(F.min(F.struct("pos", "word", "canonical", "ratio")).alias("h"))
        .select(key, "h.word", F.col("h.canonical").alias("entity"), "h.ratio")
    )


def find_entities(files: DataFrame, text_col: str, aliases: DataFrame, key: str) -> DataFrame:
    """``entity`` per row: substring match first, fuzzy words for the rest."""
    direct = match_substrings(files, text_col, aliases, key, "_direct")
    rest = direct.filter(F.col("_direct").isNull())
    fuzzy = match_fuzzy(rest, text_col, aliases, key).select(key, F.col("entity").alias("_fuzzy"))
    return (
        direct.join(fuzzy, key, "left")
        .withColumn("entity", F.coalesce("_direct", "_fuzzy"))
        .drop("_direct", "_fuzzy")
    )


def learn_entities(decisions: DataFrame, mappings: DataFrame, learned: DataFrame) -> DataFrame:
    """New names among the detected entities, whatever the action was."""
    known = mappings.select(F.col("canonical").alias("name")).unionByName(learned.select("name"))
    return (
        decisions.filter(F.coalesce("entity_detected", F.lit("")) != "")
        .select(F.col("entity_detected").alias("name"))
        .distinct()
        .join(known, "name", "left_anti")
    )


def add_pending(pending: DataFrame, new: DataFrame) -> DataFrame:
    """Pending fuzzy matches, one per (detected, possible_match); the earlier row stays."""
    rows = pending.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = F.min(F.struct("_new", "file_path", "confidence")).alias("f")
    return (
        rows.groupBy("detected", "possible_match")
        .agg(first)
        .select("detected", "possible_match", "f.confidence", "f.file_path")
    )


def apply_confirmations(
    mappings: DataFrame, learned: DataFrame, pending: DataFrame, verdicts: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store tables after ``verdicts`` (detected, canonical, confirmed).

    A confirmed match becomes an alias of its canonical name; a learned name
    that gains an alias turns canonical. A rejected match becomes a learned
    name. Either way the detected text leaves the pending list.

    ``mappings``: (canonical, alias) with one row per alias, NULL alias for none.
    """
    yes = verdicts.filter("confirmed").select("canonical", F.col("detected").alias("alias")).distinct()
    canon = mappings.select("canonical").distinct()
    names = learned.select(F.col("name").alias("canonical")).distinct()
    known = yes.join(canon.unionByName(names).distinct(), "canonical", "left_semi")
    new_mappings = mappings.unionByName(known).distinct()
    promoted = known.select(F.col("canonical").alias("name")).distinct()
    rejected = verdicts.filter(~F.col("confirmed")).select(F.col("detected").alias("name")).distinct()
    new_learned = (
        learned.select("name")
        .join(promoted, "name", "left_anti")
        .unionByName(rejected.join(canon.withColumnRenamed("canonical", "name"), "name", "left_anti"))
        .distinct()
    )
    new_pending = pending.join(verdicts.select("detected").distinct(), "detected", "left_anti")
    return new_mappings, new_learned, new_pending
