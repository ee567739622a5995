"""Queries of context models, classification, evaluation, the spacing study, alignment and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symstream.functions import text as T
from symstream.operators import adaptive, align, coder, counts, evaluate, models, search, words
from symstream.session import cut
from symstream.sources.tables import spread, table

from . import model_sql
from .text_plans import JAVA_WS, WS_SQL, docs, lines
from .text_plans import SQL as TEXT_SQL

#: Order of the relational models of the queries.
ORDER = 2


def _trained(spark: SparkSession, sf_dir: str, order: int = ORDER) -> models.Model:
    return models.train(docs(spark, sf_dir), "lang", "text", order)


def _r(c, digits: int = 4):  # noqa: ANN001, ANN202
    return F.round(c, digits)


def model_counters(spark, sf_dir):
    """Contexts, usable contexts, counters and symbols of the models, by order."""
    return _trained(spark, sf_dir).statistics()


def context_model(spark, sf_dir):
    """The tables of the models of order 1: weights, totals, and the mass that exclusions take away below."""
    m = _trained(spark, sf_dir, 1)
    return m.sym.join(m.ctx, ["model", "k", "ctx"]).select("model", "k", "ctx", "sym", "n", "weight", "occurrences", "types", "mass", "below")


def order0_entropy(spark, sf_dir):
    counted = counts.frequencies(docs(spark, sf_dir).where("text IS NOT NULL AND lang IS NOT NULL").select("lang", F.explode(T.symbols("text")).alias("sym")), ["lang", "sym"])
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    return counted.join(total, "lang").groupBy("lang").agg(_r(F.sum(-F.col("n") / F.col("total") * F.log(2.0, F.col("n") / F.col("total")))).alias("entropy"))


def codelength_o1(spark, sf_dir):
    return models.codelengths(docs(spark, sf_dir), "doc_id", "text", _trained(spark, sf_dir, 1)).withColumn("bits", _r("bits", 3))


def codelength_o1_no_exclusions(spark, sf_dir):
    return models.codelengths(docs(spark, sf_dir), "doc_id", "text", _trained(spark, sf_dir, 1), exclusions=False).withColumn("bits", _r("bits", 3))


def _scored(spark, sf_dir, order=ORDER):  # noqa: ANN001, ANN202
    return models.codelengths(docs(spark, sf_dir), "doc_id", "text", _trained(spark, sf_dir, order))


def lang_identify(spark, sf_dir):
    """The flagship: for each document the cheapest and the next cheapest model of the languages of the documents."""
    best = models.best_models(_scored(spark, sf_dir), "doc_id")
    return best.join(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "best", _r("best_bits", 3).alias("best_bits"), "second", _r("second_bits", 3).alias("second_bits"))


def lang_identify_o1(spark, sf_dir):
    return models.best_models(_scored(spark, sf_dir, 1), "doc_id").select("doc_id", "best", _r("best_bits", 3).alias("best_bits"), "second", _r("second_bits", 3).alias("second_bits"))


def precision_at_1(spark, sf_dir):
    return lang_identify(spark, sf_dir).where("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.avg((F.col("best") == F.col("lang")).cast("double")).alias("precision"))


def confusion_lang(spark, sf_dir):
    return evaluate.confusion(lang_identify(spark, sf_dir), "lang", "best")


def _word_scores(spark, sf_dir):  # noqa: ANN001, ANN202
    rows = docs(spark, sf_dir)
    return words.word_codelengths(rows, "doc_id", "text", words.train_words(rows, "lang", "text"))


def word_codelength(spark, sf_dir):
    """Documents as words and what stands between them, under the word models of every language."""
    return _word_scores(spark, sf_dir).withColumn("bits", _r("bits", 3))


def word_identify(spark, sf_dir):
    """The cheapest and the next cheapest word models of each document."""
    return models.best_models(_word_scores(spark, sf_dir).withColumn("bits", _r("bits", 3)), "doc_id")


def _tracked(spark, sf_dir):  # noqa: ANN001, ANN202
    return models.track(docs(spark, sf_dir), "doc_id", "text", _trained(spark, sf_dir, 1))


def symbol_winner_share(spark, sf_dir):
    return models.winners(_tracked(spark, sf_dir).withColumn("bits", _r("bits", 6)), "doc_id").withColumn("share", _r("share", 6))


def running_entropy(spark, sf_dir):
    return models.running_entropy(_tracked(spark, sf_dir), "doc_id", 500).select("doc_id", "model", "pos", _r("bits_so_far", 3).alias("bits_so_far"), _r("entropy").alias("entropy"))


def divergence_words(spark, sf_dir):
    rows = models.word_divergence(_tracked(spark, sf_dir), "doc_id", "ml", "en")
    return rows.select("doc_id", "word_no", *[_r(c).alias(c) for c in ("bits_a", "bits_b", "divergence")])


def information_radius(spark, sf_dir):
    rows = models.information(_tracked(spark, sf_dir), "doc_id", "ml", "ml-latn")
    return rows.select("doc_id", *[_r(c).alias(c) for c in ("entropy_a", "entropy_b", "radius", "absolute", "signed")])


def line_max_bits(spark, sf_dir):
    return _tracked(spark, sf_dir).groupBy("doc_id", "model").agg(_r(F.max("bits")).alias("max_bits"), _r(F.sum("bits"), 3).alias("bits"))


def probabilities(spark, sf_dir):
    """Mean probability of the symbols under each model."""
    return _tracked(spark, sf_dir).groupBy("doc_id", "model").agg(_r(F.avg(F.pow(F.lit(2.0), -F.col("bits"))), 5).alias("mean_probability"))


def _matrix(spark, sf_dir):  # noqa: ANN001, ANN202
    """Bits a symbol of documents (rows) under models (columns), with the documents' languages."""
    scored = _scored(spark, sf_dir, 1)
    gold = docs(spark, sf_dir).where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("label"))
    return scored.join(gold, "doc_id").select(F.col("doc_id").alias("row"), F.col("model").alias("column"), _r(F.col("bits") / F.col("symbols"), 6).alias("value"), "label")


def map_by_column(spark, sf_dir):
    """Average precision of each language's column of the score matrix of documents and models."""
    return evaluate.mean_average_precision(_matrix(spark, sf_dir)).withColumn("average_precision", _r("average_precision", 6))


def map_by_column_but_worst(spark, sf_dir):
    """The same without each language's ten worst placed documents."""
    return evaluate.mean_average_precision(_matrix(spark, sf_dir), ignore=10).withColumn("average_precision", _r("average_precision", 6))


def map_by_row(spark, sf_dir):
    """Average precision of each document's row."""
    return evaluate.mean_average_precision_by_rows(_matrix(spark, sf_dir)).withColumn("average_precision", _r("average_precision", 6))


def matrix_extremes(spark, sf_dir):
    """Least and greatest value of each row of the matrix, and of all."""
    return evaluate.extremes(_matrix(spark, sf_dir))


#: Thresholds of bits a symbol, and the grids of the sweep: first, step, number.
THRESHOLDS = [round(-0.3 + 0.01 * i, 2) for i in range(61)]
SYMBOL_GRID, TEXT_GRID = (-9.0, 0.05, 301), (-0.3, 0.01, 61)


def _verdicts(spark, sf_dir):  # noqa: ANN001, ANN202
    """Documents with a text and a verdict: whether any reviewer found them abusive."""
    found = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("abusive").alias("abusive"))
    return docs(spark, sf_dir).where("text IS NOT NULL").join(found.where("abusive IS NOT NULL"), "doc_id").select("doc_id", "text", (F.col("abusive") == 1).alias("relevant"))


def _gains(spark, sf_dir):  # noqa: ANN001, ANN202
    """(doc_id, gain) of each symbol of the judged documents: bits of the model of harmless ones less bits of that of abusive ones."""
    rows = _verdicts(spark, sf_dir)
    model = models.train(rows.select(F.when(F.col("relevant"), "positive").otherwise("negative").alias("m"), "text"), "m", "text", 1)
    of = lambda name: F.sum(F.when(F.col("model") == name, F.col("bits")))
    cost = models.gram_bits(counts.grams(rows, [], "text", 1), model).groupBy("gram").agg(of("negative").alias("n"), of("positive").alias("p"))
    return counts.grams(rows, ["doc_id"], "text", 1).join(cost.select("gram", _r(F.col("n") - F.col("p")).alias("gain")), "gram").where("gain IS NOT NULL").select("doc_id", "gain")


def relevance_sweep(spark, sf_dir):
    """Recall and precision of finding abusive documents by both models, for all pairs of a symbol and a text threshold."""
    swept = evaluate.relevance_sweep(_gains(spark, sf_dir), "doc_id", "gain", _verdicts(spark, sf_dir).select("doc_id", "relevant"), SYMBOL_GRID, TEXT_GRID)
    return swept.withColumns({c: _r(c, 6) for c in ("recall", "precision")})


def relevance_best(spark, sf_dir):
    """The best thresholds by norm."""
    return evaluate.best_thresholds(relevance_sweep(spark, sf_dir))


def _judged(spark, sf_dir):  # noqa: ANN001, ANN202
    """Bits a symbol by which the model of abusive documents is dearer."""
    mean = _gains(spark, sf_dir).groupBy("doc_id").agg(_r(-F.avg("gain"), 6).alias("score"))
    return mean.join(_verdicts(spark, sf_dir).select("doc_id", "relevant"), "doc_id").select("score", "relevant")


def recall_precision(spark, sf_dir):
    return evaluate.recall_precision(_judged(spark, sf_dir), "score", "relevant", THRESHOLDS).withColumns({c: _r(c, 6) for c in ("recall", "precision")})


def break_even(spark, sf_dir):
    return evaluate.break_even(evaluate.recall_precision(_judged(spark, sf_dir), "score", "relevant", THRESHOLDS)).withColumn("break_even", _r("break_even", 6))


def topic_prior(spark, sf_dir):
    counted = counts.frequencies(docs(spark, sf_dir).where("lang IS NOT NULL"), ["lang"])
    return counted.withColumn("prior", _r(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a row for each topic


def _spacing(spark, sf_dir):  # noqa: ANN001, ANN202
    """Runs of the study: of rows delivered twice the latest counts, failed ones are left out."""
    rows = table(spark, sf_dir, "spacing_results").where("success AND bits_per_char > 0")
    return rows.groupBy("run_id", "experiment", "spacing").agg(F.max(F.struct("run_at", "bits_per_char", "compression_ratio"))["bits_per_char"].alias("bpc"), F.count(F.lit(1)).alias("deliveries"))


def spacing_preference(spark, sf_dir):
    """The best and the worst spacing of each run, and their distance."""
    return _spacing(spark, sf_dir).groupBy("run_id", "experiment").agg(
        F.min(F.struct("bpc", "spacing"))["spacing"].alias("best"), F.max(F.struct("bpc", "spacing"))["spacing"].alias("worst"), _r(F.max("bpc") - F.min("bpc"), 6).alias("range")
    )


def boundary_understanding(spark, sf_dir):
    """How often models of an experiment prefer the spaces that stand in the text, and by how much."""
    runs = _spacing(spark, sf_dir).groupBy("run_id", "experiment").agg(F.max(F.when(F.col("spacing") == "original", F.col("bpc"))).alias("original"), F.max(F.when(F.col("spacing") == "no_spaces", F.col("bpc"))).alias("bare"))
    gain = F.col("bare") - F.col("original")
    return runs.where("original IS NOT NULL AND bare IS NOT NULL").groupBy("experiment").agg(F.count(F.lit(1)).alias("runs"), F.count_if(gain > 0).alias("prefer_original"), F.count_if(gain > 0.1).alias("good"), _r(F.avg(gain), 6).alias("mean_gain"))


def best_configuration(spark, sf_dir):
    """Mean bits a character by experiment and spacing, with the spacing's place within the experiment."""
    means = _spacing(spark, sf_dir).groupBy("experiment", "spacing").agg(_r(F.avg("bpc"), 6).alias("mean_bpc"), F.count(F.lit(1)).alias("runs"))
    return means.withColumn("place", F.row_number().over(Window.partitionBy("experiment").orderBy("mean_bpc", "spacing")))


def event_bigram_model(spark, sf_dir):
    """Each user's events as a stream of symbols: how often one type follows another, and its bits by the counts of order 1."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select("event_type", F.lag("event_type").over(w).alias("before")).where("before IS NOT NULL")
    counted = counts.frequencies(steps, ["before", "event_type"])
    total = F.sum("n").over(Window.partitionBy("before"))
    types = F.count(F.lit(1)).over(Window.partitionBy("before"))
    return counted.withColumn("bits", _r(-F.log(2.0, (2 * F.col("n") - 1) / (2 * total - types + types)), 6))


def parallel_line_ratio(spark, sf_dir):
    """Lines of both scripts: codelengths, each under the model of its own corpus, and the larger over the smaller one; the same by symbol."""
    rows = _corpora(spark, sf_dir)
    model = models.train(rows, "corpus", "text", 1)
    own = models.gram_codelengths(counts.grams(rows, ["line_id", "corpus"], "text", 1), ["line_id", "corpus"], model).where("corpus = model")
    of = lambda corpus, c: F.max(F.when(F.col("corpus") == corpus, F.col(c)))
    both = own.groupBy("line_id").agg(of("native", "bits").alias("a"), of("romanised", "bits").alias("b"), of("native", "symbols").alias("n_a"), of("romanised", "symbols").alias("n_b"))
    each = both.withColumn("x", F.col("a") / F.col("n_a")).withColumn("y", F.col("b") / F.col("n_b"))
    return each.select("line_id", _r("a", 3).alias("a"), _r("b", 3).alias("b"), "n_a", "n_b", _r(align.parallel_ratio("a", "b"), 6).alias("ratio"), _r(align.parallel_ratio("x", "y"), 6).alias("ratio_by_symbol"))


def alignment_measures(spark, sf_dir):
    """Measures of the ratios of codelengths, and of those by symbol."""
    rows = cut(parallel_line_ratio(spark, sf_dir))
    out = None
    for name, c in (("bits", "ratio"), ("bits_by_symbol", "ratio_by_symbol")):
        one = align.alignment_measures(rows, c, 1.5).select(F.lit(name).alias("of"), "pairs", *[_r(x, 5).alias(x) for x in ("mean_ratio", "mean_log2", "share_above", "greatest", "area")])
        out = one if out is None else out.unionByName(one)
    return out


def lines_above_ratio(spark, sf_dir):
    return align.above(parallel_line_ratio(spark, sf_dir), "ratio", [1.0, 1.1, 1.25, 1.5, 2.0, 4.0]).withColumn("share", _r("share", 6))


def realigned_lines(spark, sf_dir):
    return align.realign(parallel_line_ratio(spark, sf_dir), "ratio", 2)


def edit_distance_lines(spark, sf_dir):
    """Indel distance of each line's romanised field and the transliteration of its native field."""
    rows = lines(spark, sf_dir).select("line_id", T.transliterate("malayalam_lines").alias("a"), F.col("transliterated_lines").alias("b"))
    return rows.select("line_id", align.edit_distance_column(F.col("a"), F.col("b")).alias("distance"), F.levenshtein("a", "b").alias("unit_distance"))


def aligned_sentences(spark, sf_dir):
    """Sentences of both fields of each line, aligned by their lengths: how often each kind of move is made."""
    lengths = lambda c: F.transform(F.filter(F.split(c, r"(?<=[.!?\u0964])\s+|\n+"), lambda x: F.length(x) > 0), lambda x: F.length(x))
    rows = spread(lines(spark, sf_dir).select("line_id", lengths("malayalam_lines").alias("a"), lengths("transliterated_lines").alias("b")))
    return align.align_columns(rows, "line_id", "a", "b").groupBy("n_a", "n_b").agg(F.count(F.lit(1)).alias("moves"), F.sum("cost").alias("cost"))


def split_compression(spark, sf_dir):
    """Models of the training splits of both corpora, on both splits: bits a symbol."""
    split = cut(counts.seeded_split(_corpora(spark, sf_dir), "corpus", "line_id"))
    model = models.train(split.where("split = 'train'"), "corpus", "text", 1)
    scored = models.gram_codelengths(counts.grams(split, ["corpus", "split"], "text", 1), ["corpus", "split"], model).where("corpus = model")
    return scored.select("corpus", "split", F.col("symbols").alias("n_symbols"), _r(F.col("bits") / F.col("symbols")).alias("bits_per_symbol"))


def orders_curve(spark, sf_dir):
    """Bits a symbol of both corpora under their own models, by the models' order."""
    counted = counts.text_gram_counts(_corpora(spark, sf_dir), "corpus", "text", 3).withColumnRenamed("corpus", "model")
    scored = models.own_codelengths(models.tables(counts.context_counts(counted, ["model"], 3), 3))
    return scored.select(F.col("model").alias("corpus"), "max_order", _r(F.col("bits") / F.col("symbols")).alias("bits_per_symbol"))


def sizes_curve(spark, sf_dir):
    """Bits a symbol of whole corpora under models of seeded parts of them."""
    rows, out = _corpora(spark, sf_dir), None
    for percent in (10, 25, 50, 100):
        part = counts.seeded_split(rows, "corpus", "line_id", percent / 100).where("split = 'test'")
        model = models.train(part, "corpus", "text", 1)
        one = models.gram_codelengths(counts.grams(rows, ["corpus"], "text", 1), ["corpus"], model).where("corpus = model")
        one = one.select("corpus", F.lit(percent).alias("percent"), _r(F.col("bits") / F.col("symbols")).alias("bits_per_symbol"))
        out = one if out is None else out.unionByName(one)
    return out


def radius_by_model(spark, sf_dir):
    """For each document and each other language's model: how its bits differ from those of the document's own, absolutely and signed, a symbol,
    and the mean of both.
    """
    rows = docs(spark, sf_dir).where("lang IS NOT NULL AND text IS NOT NULL")
    return models.divergences(rows, "doc_id", "lang", "text", _trained(spark, sf_dir, 1)).select("doc_id", "model", *[_r(c).alias(c) for c in ("absolute", "signed", "radius")])


def nearest_model(spark, sf_dir):
    """Which other language's model is nearest to a document's own, by each measure."""
    least = lambda c: F.min(F.struct(c, "model"))["model"].alias(f"by_{c}")
    return radius_by_model(spark, sf_dir).groupBy("doc_id").agg(least("absolute"), least("signed"), least("radius"))


def word_costs(spark, sf_dir):
    """Bits of each word of English documents, alone between two blanks, under every language's model."""
    found = docs(spark, sf_dir).where("lang = 'en'").select(F.explode(T.words("text")).alias("word")).distinct()
    rows = found.select("word", F.concat(F.lit(" "), "word", F.lit(" ")).alias("t"))
    return models.codelengths(rows, "word", "t", _trained(spark, sf_dir, 1)).select("word", "model", _r("bits", 3).alias("bits"))


def found_orders(spark, sf_dir):
    """How long the context is in which the models find a document's symbols: the stream of orders, by language and model."""
    grams = counts.gram_counts(docs(spark, sf_dir).where("lang IS NOT NULL"), ["lang"], "text", ORDER)
    return words.order_stream(words.found_orders(grams, _trained(spark, sf_dir), ["lang"]), ["lang", "model"])


def order_codelength(spark, sf_dir):
    """Documents as a stream of orders and one of symbols, under the models of their own language."""
    rows = words.order_codelengths(docs(spark, sf_dir), "doc_id", "lang", "text", _trained(spark, sf_dir, 1))
    return rows.select("doc_id", "model", _r("order_bits", 3).alias("order_bits"), _r("symbol_bits", 3).alias("symbol_bits"))


def predicted_symbols(spark, sf_dir):
    """The share of the documents' symbols that each model finds in its longest context, and of those that it finds at all."""
    n = lambda least: F.sum(F.when(F.col("found") >= least, F.col("n")).otherwise(0)) / F.sum("n")
    return found_orders(spark, sf_dir).groupBy("lang", "model").agg(_r(n(ORDER), 6).alias("longest"), _r(n(0), 6).alias("found_at_all"))


def word_order_costs(spark, sf_dir):
    """Romanised lines with their words as they are, backwards and sorted: bits a symbol under the model of the lines as they are."""
    rows = lines(spark, sf_dir).where("transliterated_lines IS NOT NULL").select(F.lit("m").alias("m"), F.array_join(T.words("transliterated_lines"), " ").alias("text"))
    model = models.train(rows, "m", "text", 2)
    w = T.words("text")
    named = lambda name, c: F.struct(F.lit(name).alias("word_order"), F.array_join(c, " ").alias("t"))
    each = rows.select(F.inline(F.array(named("original", w), named("backwards", F.reverse(w)), named("sorted", F.array_sort(w)))))
    scored = models.gram_codelengths(counts.grams(spread(each), ["word_order"], "t", 2), ["word_order"], model)
    return scored.select("word_order", F.col("symbols").alias("n_symbols"), _r(F.col("bits") / F.col("symbols")).alias("bits_per_symbol"))


def description_length(spark, sf_dir):
    """Bits of each language's documents under their own model and bits of the model, at 32 for each counter: what both take together."""
    model = _trained(spark, sf_dir, 1)
    size = model.statistics().groupBy("model").agg((F.sum("counters") * 32).alias("model_bits"))
    own = models.gram_codelengths(counts.grams(docs(spark, sf_dir).where("lang IS NOT NULL AND text IS NOT NULL"), ["lang"], "text", 1), ["lang"], model).where("lang = model")
    return own.join(size, "model").select("model", "model_bits", _r("bits", 2).alias("text_bits"), _r(F.col("bits") + F.col("model_bits"), 2).alias("total_bits"))


#: Letters that new words may have in one another's place.
CLASSES = ("aeiou", "bdpt", "ck", "mn")


def new_words(spark, sf_dir):
    """For each English word the cheapest of the words that differ in one letter of its class and aren't there, by the English model."""
    known = docs(spark, sf_dir).where("lang = 'en'").select(F.explode(T.words("text")).alias("word")).where(F.col("word").rlike("^[a-z]{2,}$")).distinct()
    letter = F.substr("word", F.col("i"), F.lit(1))
    kind = F.coalesce(*[F.when(F.contains(F.lit(c), letter), F.lit(c)) for c in CLASSES])
    placed = known.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")).withColumn("kind", kind).where("kind IS NOT NULL")
    made = placed.select("word", "i", F.explode(T.symbols("kind")).alias("x")).select("word", F.concat(F.left("word", F.col("i") - 1), "x", F.substr("word", F.col("i") + 1)).alias("candidate"))
    fresh = made.distinct().join(known.select(F.col("word").alias("candidate")), "candidate", "left_anti")
    scored = models.codelengths(fresh.select("candidate").distinct(), "candidate", "candidate", _trained(spark, sf_dir, 1)).where("model = 'en'").select("candidate", _r("bits", 3).alias("bits"))
    best = fresh.join(scored, "candidate").groupBy("word").agg(F.min(F.struct("bits", "candidate")).alias("b"))
    return best.select("word", F.col("b.candidate").alias("new_word"), F.col("b.bits").alias("bits"))


def segmentation_scores(spark, sf_dir):
    """Boundaries of lines with their spaces moved to every fifth sign, against the lines as they are."""
    rows = lines(spark, sf_dir).where("transliterated_lines IS NOT NULL").select(F.regexp_replace("transliterated_lines", r"\s+", " ").alias("gold"))
    found = rows.withColumn("found", F.regexp_replace(F.replace("gold", F.lit(" "), F.lit("")), r"(?s)(.{5})", "$1 "))
    return evaluate.segmentation(found, "found", "gold")


def _corpora(spark, sf_dir):  # noqa: ANN001, ANN202
    """Lines of the native and the romanised corpus."""
    rows = lines(spark, sf_dir).select("line_id", F.inline(F.array(F.struct(F.lit("native").alias("corpus"), F.col("malayalam_lines").alias("text")), F.struct(F.lit("romanised").alias("corpus"), F.col("transliterated_lines").alias("text")))))
    return rows.where("text IS NOT NULL")


def cross_compression(spark, sf_dir):
    """The pipeline: models of both corpora, each on the lines of both; bits a symbol and the ratio to plain UTF-8."""
    rows = _corpora(spark, sf_dir)
    model = models.train(rows, "corpus", "text", 1)
    sizes = rows.groupBy("corpus").agg(F.sum(F.length("text")).alias("n_symbols"), F.sum(F.octet_length("text")).alias("n_bytes"))
    scored = models.gram_codelengths(counts.grams(spread(rows), ["corpus"], "text", 1), ["corpus"], model)
    return scored.join(sizes, "corpus").select("corpus", "model", "n_symbols", _r(F.col("bits") / F.col("n_symbols")).alias("bits_per_symbol"), _r(8 * F.col("n_bytes") / F.col("bits")).alias("ratio"))


def distinguishability(spark, sf_dir):
    """How many bits a symbol each corpus gains by its own model."""
    w = cross_compression(spark, sf_dir).groupBy("corpus").agg(
        F.sum(F.when(F.col("corpus") == F.col("model"), F.col("bits_per_symbol"))).alias("own"), F.sum(F.when(F.col("corpus") != F.col("model"), F.col("bits_per_symbol"))).alias("other")
    )
    return w.select("corpus", "own", "other", _r(F.col("other") - F.col("own")).alias("gain"), (F.col("own") < F.col("other")).alias("prefers_own"))


def spacing_study(spark, sf_dir):
    """The study: the four spacings of the whole lines under both models, in bits a symbol."""
    rows = _corpora(spark, sf_dir)
    model = models.train(rows, "corpus", "text", 1)
    spaced = rows.select("corpus", F.inline(T.spacing_variants("text")))
    scored = models.gram_codelengths(counts.grams(spread(spaced), ["corpus", "spacing"], "variant", 1), ["corpus", "spacing"], model)
    return scored.select("corpus", "spacing", "model", F.col("symbols").alias("n_symbols"), _r(F.col("bits") / F.col("symbols")).alias("bits_per_symbol"))


def event_streams(spark, sf_dir):
    """Each user's events as a stream of symbols, a number for each type that there is, scored by a model of order 2 of all users."""
    rows = table(spark, sf_dir, "events").where("event_type IS NOT NULL")
    kinds = counts.dense_ids(rows.select("event_type").distinct(), [F.asc("event_type")], "n")
    numbered = rows.join(kinds, "event_type").select("user_id", "ts", "event_id", T.numbers_as_text(F.array("n")).alias("sym"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    grams = numbered.select("user_id", F.concat_ws("", F.lag("sym", 2).over(w), F.lag("sym", 1).over(w), "sym").alias("gram"))
    counted = counts.frequencies(grams.select(F.lit("events").alias("model"), "gram"), ["model", "gram"])
    model = models.tables(counts.context_counts(counted, ["model"], 2), 2, alphabet=256)
    return models.gram_codelengths(grams, ["user_id"], model).select("user_id", "symbols", _r("bits", 3).alias("bits"))


# --- order-dependent queries, held against brute force in the tests ----------------------------------------------------------------


def adaptive_bits(spark, sf_dir):
    """Each line scored by a model of order 3 that learns it from the start, in bytes."""
    rows = spread(lines(spark, sf_dir).select("line_id", "malayalam_lines"))
    return adaptive.adaptive_bits(rows, "line_id", "malayalam_lines").withColumn("bits", _r("bits"))


def codec_round_trip(spark, sf_dir):
    """Documents in compressed form: bytes before and after, and whether the decoder gives them back."""
    rows = docs(spark, sf_dir).where("text IS NOT NULL").select(F.col("doc_id").alias("k"), F.col("text").alias("t"))
    both = coder.compressed(spark, F.col("t").cast("binary"), 3, "D"), coder.decompressed(spark, F.col("coded"), 3, "D")
    back = rows.withColumn("coded", both[0]).withColumn("back", both[1].cast("string"))
    return back.select("k", F.octet_length("t").alias("n_bytes"), F.octet_length("coded").alias("coded_bytes"), (F.col("t") == F.col("back")).alias("same"))


def _static(spark, sf_dir, order=3):  # noqa: ANN001, ANN202
    rows = lines(spark, sf_dir).select(F.lit("m").alias("m"), F.lower("transliterated_lines").alias("text"))
    return search.static_models(models.train(rows, "m", "text", order))["m"]


def _dense(spark, sf_dir, order=3):  # noqa: ANN001, ANN202
    """The model of _static as arrays."""
    rows = lines(spark, sf_dir).select(F.lit("m").alias("model"), F.lower("transliterated_lines").alias("text"))
    counted = counts.text_gram_counts(rows, "model", "text", order)
    return search.dense_model(models.tables(counts.context_counts(counted, ["model"], order), order))


def _sentences(spark, sf_dir):  # noqa: ANN001, ANN202
    """All lines of the romanised corpus."""
    rows = lines(spark, sf_dir).select("line_id", F.lower("transliterated_lines").alias("gold"))
    return spread(rows.where("gold IS NOT NULL"))


def segment_lines(spark, sf_dir):
    """Lines without their spaces, and the spaces that the search puts in."""
    rows = _sentences(spark, sf_dir).select("line_id", F.regexp_replace("gold", r"\s+", "").alias("t"))
    return search.apply_batches(rows, "line_id", "t", _dense(spark, sf_dir), search.segment_texts).withColumn("bits", _r("bits"))


def decode_keys(spark, sf_dir):
    """Lines as they are typed on a telephone's keys, and the letters that the search finds."""
    rows = _sentences(spark, sf_dir).select("line_id", T.phone_keys("gold").alias("t"))
    return search.apply_batches(rows, "line_id", "t", search.Keypad(_dense(spark, sf_dir)), lambda texts, pad: pad(texts)).withColumn("bits", _r("bits"))


CONFUSIONS = ("8 100 i -> l", "5 100 o -> e", "3 100 rn -> m")


def correct_lines(spark, sf_dir):
    rules = [r for r in map(search.parse_confusions, CONFUSIONS) if r]
    rows = _sentences(spark, sf_dir).select("line_id", F.replace("gold", F.lit("l"), F.lit("i")).alias("t"))
    return search.apply(rows, "line_id", "t", _static(spark, sf_dir), lambda t, m: search.correct(t, m, rules)).withColumn("bits", _r("bits"))


def mark_languages(spark, sf_dir):
    """Stretches of the lines by the cheapest models."""
    trained = models.train(docs(spark, sf_dir).where("lang IN ('en', 'ml', 'hi', 'ta')"), "lang", "text", 2)
    rows = spread(lines(spark, sf_dir).select("line_id", "malayalam_lines"))
    return search.mark_texts(rows, "line_id", "malayalam_lines", search.static_models(trained))


def markup_statistics(spark, sf_dir):
    """Symbols, stretches and switches of mark_languages by model."""
    return search.markup_statistics(mark_languages(spark, sf_dir))


def held_out_identify(spark, sf_dir):
    return adaptive.held_out(docs(spark, sf_dir).where("lang IS NOT NULL"), "doc_id", "lang", "text", 1).withColumn("bits", _r("bits", 3))


_CTX1 = """g AS (SELECT lang AS model, doc_id, substr(text, greatest(i - 1, 1)::INT, least(i, 2)::INT) AS gram FROM (SELECT lang, doc_id, text, unnest(generate_series(1, length(text))) AS i FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)),
gc AS (SELECT model, gram, count(*) AS n FROM g GROUP BY 1, 2),
s AS (SELECT model, 0 AS k, '' AS ctx, right(gram, 1) AS sym, sum(n)::BIGINT AS n FROM gc GROUP BY 1, 4 UNION ALL SELECT model, 1, left(gram, 1), right(gram, 1), sum(n)::BIGINT FROM gc WHERE length(gram) = 2 GROUP BY 1, 3, 4),
sw AS (SELECT *, 2 * n - 1 AS weight FROM s),
b AS (SELECT h.model, h.ctx, sum(l.weight)::BIGINT AS below FROM sw h JOIN sw l ON h.model = l.model AND h.sym = l.sym AND h.k = 1 AND l.k = 0 GROUP BY 1, 2),
c AS (SELECT sw.model, k, sw.ctx, sum(n)::BIGINT AS occurrences, count(*) AS types, sum(weight)::BIGINT AS mass, coalesce(max(CASE WHEN k = 1 THEN below END), 0) AS below FROM sw LEFT JOIN b ON sw.model = b.model AND sw.ctx = b.ctx GROUP BY 1, 2, 3)"""


def _bits_sql(exclusions: bool) -> str:
    below = "c1.below" if exclusions else "0"
    left0 = f"(c0.mass - CASE WHEN u1 THEN {below} ELSE 0 END)"
    rest = f"log2((65536 - {'c0.types' if exclusions else '0'} + 1)::DOUBLE)"
    order0 = f"CASE WHEN s0.weight IS NOT NULL THEN -log2(s0.weight::DOUBLE / ({left0} + c0.types)) ELSE CASE WHEN {left0} > 0 THEN -log2(c0.types::DOUBLE / ({left0} + c0.types)) ELSE 0 END + {rest} END"
    return f"""{_CTX1},
e AS (SELECT doc_id, i, substr(text, greatest(i - 1, 1)::INT, least(i, 2)::INT) AS gram FROM (SELECT doc_id, text, unnest(generate_series(1, length(text))) AS i FROM documents WHERE text IS NOT NULL)),
d AS (SELECT DISTINCT gram FROM e),
x AS (SELECT d.gram, c0.model, s1.weight AS w1, c1.occurrences >= 2 AS u, c1.types AS t1, c1.mass AS m1, s0.weight AS w0, c0.types AS t0,
 coalesce(c1.occurrences >= 2, false) AS u1, {order0} AS zero FROM d JOIN c c0 ON c0.k = 0
 LEFT JOIN c c1 ON c1.k = 1 AND length(d.gram) = 2 AND c1.model = c0.model AND c1.ctx = left(d.gram, 1)
 LEFT JOIN sw s1 ON s1.k = 1 AND length(d.gram) = 2 AND s1.model = c0.model AND s1.ctx = left(d.gram, 1) AND s1.sym = right(d.gram, 1)
 LEFT JOIN sw s0 ON s0.k = 0 AND s0.model = c0.model AND s0.sym = right(d.gram, 1)),
gb AS (SELECT gram, model, CASE WHEN u1 AND w1 IS NOT NULL THEN -log2(w1::DOUBLE / (m1 + t1)) WHEN u1 THEN -log2(t1::DOUBLE / (m1 + t1)) + zero ELSE zero END AS bits FROM x),
track AS (SELECT e.doc_id, e.i - 1 AS pos, right(e.gram, 1) AS sym, gb.model, gb.bits FROM e JOIN gb USING (gram))"""


_TRACK = "WITH " + _bits_sql(True)
_LINES = "(SELECT line_id, any_value(malayalam_lines) AS malayalam_lines, any_value(transliterated_lines) AS transliterated_lines FROM evaluation GROUP BY line_id)"
_SPACING = "(SELECT run_id, experiment, spacing, max(struct_pack(a := run_at, b := bits_per_char)).b AS bpc FROM spacing_results WHERE success AND bits_per_char > 0 GROUP BY 1, 2, 3)"
_CORPORA = "(SELECT line_id, 'native' AS corpus, malayalam_lines AS text FROM " + _LINES + " UNION ALL SELECT line_id, 'romanised', transliterated_lines FROM " + _LINES + ")"
_CROSS = (
    _TRACK.replace("SELECT lang AS model, doc_id, substr", "SELECT corpus AS model, line_id, substr")
    .replace("(SELECT lang, doc_id, text, unnest(generate_series(1, length(text))) AS i FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)", f"(SELECT corpus, line_id, text, unnest(generate_series(1, length(text))) AS i FROM {_CORPORA} WHERE text IS NOT NULL)")
    .replace("SELECT doc_id, i, substr", "SELECT corpus, i, substr")
    .replace("(SELECT doc_id, text, unnest(generate_series(1, length(text))) AS i FROM documents WHERE text IS NOT NULL)", f"(SELECT corpus, text, unnest(generate_series(1, length(text))) AS i FROM {_CORPORA} WHERE text IS NOT NULL)")
    .replace("SELECT e.doc_id, e.i - 1 AS pos", "SELECT e.corpus, e.i - 1 AS pos")
    + f", z AS (SELECT corpus, sum(length(text)) AS n_symbols, sum(strlen(text)) AS n_bytes FROM {_CORPORA} WHERE text IS NOT NULL GROUP BY 1)"
    ", x2 AS (SELECT corpus, model, z.n_symbols::BIGINT AS n_symbols, round(sum(bits) / z.n_symbols, 4) AS bits_per_symbol, round(8 * z.n_bytes / sum(bits), 4) AS ratio FROM track JOIN z USING (corpus) GROUP BY corpus, model, z.n_symbols, z.n_bytes)"
)

_PAIR = (
    model_sql.track(f"(SELECT corpus AS model, text FROM {_CORPORA})", _CORPORA, "line_id, corpus", 1)
    + """, p AS (SELECT line_id, sum(bits) FILTER (WHERE corpus = 'native') AS a, sum(bits) FILTER (WHERE corpus = 'romanised') AS b, nullif(count(*) FILTER (WHERE corpus = 'native'), 0) AS n_a, nullif(count(*) FILTER (WHERE corpus = 'romanised'), 0) AS n_b FROM track WHERE corpus = model GROUP BY 1),
q AS (SELECT line_id, round(a, 3) AS a, round(b, 3) AS b, n_a, n_b, CASE WHEN a > 0 AND b > 0 THEN round(greatest(a / b, b / a), 6) END AS ratio, CASE WHEN a > 0 AND b > 0 THEN round(greatest((a / n_a) / (b / n_b), (b / n_b) / (a / n_a)), 6) END AS ratio_by_symbol FROM p)"""
)
_MEASURES = "SELECT '{name}' AS of, count(*) AS pairs, round(avg({c}), 5) AS mean_ratio, round(avg(log2({c})), 5) AS mean_log2, round(avg(({c} > 1.5)::INT), 5) AS share_above, round(max({c}), 5) AS greatest, round(avg(least(101, greatest(0, floor(round({c} * 100, 6)) - 99))) + 50 * (avg(({c} >= 2)::INT) - avg(({c} >= 300)::INT)), 5) AS area FROM q WHERE {c} IS NOT NULL"
_VERDICTS = "(SELECT doc_id, text, a = 1 AS relevant FROM documents JOIN (SELECT doc_id, max(abusive) AS a FROM labels GROUP BY 1) USING (doc_id) WHERE text IS NOT NULL AND a IS NOT NULL)"
_GAINS = (
    model_sql.track(f"(SELECT CASE WHEN relevant THEN 'positive' ELSE 'negative' END AS model, text FROM {_VERDICTS})", _VERDICTS, "doc_id", 1)
    + ", gg AS (SELECT gram, round(sum(bits) FILTER (WHERE model = 'negative') - sum(bits) FILTER (WHERE model = 'positive'), 4) AS gain FROM gb GROUP BY 1), gains AS (SELECT doc_id, gain FROM e JOIN gg USING (gram) WHERE gain IS NOT NULL)"
)
_RP = (
    "rp AS (SELECT t AS threshold, count(*) FILTER (WHERE score <= t) AS retrieved, count(*) FILTER (WHERE score <= t AND relevant) AS hits, coalesce((count(*) FILTER (WHERE score <= t AND relevant))::DOUBLE / nullif(count(*) FILTER (WHERE relevant), 0), 0.0) AS recall, "
    "coalesce((count(*) FILTER (WHERE score <= t AND relevant))::DOUBLE / nullif(count(*) FILTER (WHERE score <= t), 0), 0.0) AS precision FROM "
    f"(SELECT round(-avg(gain), 6) AS score, any_value(relevant) AS relevant FROM gains JOIN {_VERDICTS} USING (doc_id) GROUP BY doc_id), (SELECT round(-0.3 + 0.01 * i, 2)::DOUBLE AS t FROM (SELECT unnest(generate_series(0, 60)) AS i)) GROUP BY t)"
)
_SWEEP = (
    f"{_GAINS}, bn AS (SELECT doc_id, least({SYMBOL_GRID[2]}, greatest(0, floor(round((gain - ({SYMBOL_GRID[0]})) / {SYMBOL_GRID[1]}, 6)) + 1))::INT AS symbol_step, sum(gain) AS g, count(*) AS c FROM gains GROUP BY ALL), "
    f"dn AS (SELECT doc_id, unnest(generate_series(0, {SYMBOL_GRID[2]}))::INT AS symbol_step FROM (SELECT DISTINCT doc_id FROM bn)), "
    "fl AS (SELECT doc_id, symbol_step, sum(coalesce(c, 0)) OVER w AS kept, sum(coalesce(g, 0)) OVER w AS total FROM dn LEFT JOIN bn USING (doc_id, symbol_step) WINDOW w AS (PARTITION BY doc_id ORDER BY symbol_step DESC ROWS UNBOUNDED PRECEDING)), "
    "jd AS (SELECT *, max(kept) OVER (PARTITION BY doc_id) AS length FROM fl), "
    f"sc AS (SELECT relevant, symbol_step, norm, round(score, 6) AS score FROM (SELECT doc_id, symbol_step, unnest(['sum', 'mean', 'mean_kept']) AS norm, unnest([total / 100, total / nullif(length, 0), total / nullif(kept, 0)]) AS score FROM jd) JOIN {_VERDICTS} USING (doc_id) WHERE score IS NOT NULL), "
    f"ct AS (SELECT norm, symbol_step, least({TEXT_GRID[2]}, greatest(0, floor(round((score - ({TEXT_GRID[0]})) / {TEXT_GRID[1]}, 6)) + 1))::INT AS text_step, count(*) AS n, count(*) FILTER (WHERE relevant) AS h FROM sc GROUP BY ALL), "
    f"gd AS (SELECT norm, symbol_step, unnest(generate_series(0, {TEXT_GRID[2]}))::INT AS text_step FROM (SELECT DISTINCT norm, symbol_step FROM ct)), "
    "up AS (SELECT norm, symbol_step, text_step, (sum(coalesce(n, 0)) OVER w)::BIGINT AS retrieved, (sum(coalesce(h, 0)) OVER w)::BIGINT AS hits FROM gd LEFT JOIN ct USING (norm, symbol_step, text_step) WINDOW w AS (PARTITION BY norm, symbol_step ORDER BY text_step DESC ROWS UNBOUNDED PRECEDING)), "
    f"sw2 AS (SELECT *, round(coalesce(hits / nullif((SELECT count(*) FILTER (WHERE relevant) FROM {_VERDICTS}), 0), 0.0), 6) AS recall, round(coalesce(hits / nullif(retrieved, 0), 0.0), 6) AS precision FROM up WHERE text_step > 0)"
)
_MATRIX = f"{_TRACK}, v AS (SELECT doc_id AS r, model AS c, round(sum(bits) / count(*), 6) AS value FROM track GROUP BY 1, 2), l AS (SELECT v.*, lang AS label FROM v JOIN documents ON doc_id = r WHERE lang IS NOT NULL)"


def _map_sql(by: str, other: str, name: str, ignore: int = 0) -> str:
    return f"""{_MATRIX}, k AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY value, {other}) AS rank, sum((label = c)::INT) OVER (PARTITION BY {by} ORDER BY value, {other}) AS hits, sum((label = c)::INT) OVER (PARTITION BY {by}) AS whole FROM l),
z AS (SELECT *, max(CASE WHEN label = c AND hits <= greatest(whole - {ignore}, 1) THEN rank END) OVER (PARTITION BY {by}) AS last FROM k) SELECT {by} AS "{name}", round(coalesce(avg(CASE WHEN rank <= last THEN hits / rank END), 0.0), 6) AS average_precision FROM z GROUP BY 1"""


_LANGS = "(SELECT lang AS model, text FROM documents)"
_DOCS = "(SELECT doc_id, text FROM documents)"
_IDENTIFY = (
    model_sql.track(_LANGS, _DOCS, "doc_id", ORDER)
    + ", d2 AS (SELECT doc_id, model, sum(bits) AS bits FROM track GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bits, model) AS p FROM d2)"
    ", li AS (SELECT doc_id, any_value(lang) AS lang, max(model) FILTER (WHERE p = 1) AS best, round(max(bits) FILTER (WHERE p = 1), 3) AS best_bits, max(model) FILTER (WHERE p = 2) AS second, round(max(bits) FILTER (WHERE p = 2), 3) AS second_bits FROM r JOIN documents USING (doc_id) GROUP BY 1)"
)
_STREAMS = (
    "WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS n FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)), "
    "u AS (SELECT user_id, string_agg(chr((200 + n)::INT), '' ORDER BY ts, event_id) AS text FROM events JOIN k USING (event_type) GROUP BY 1), "
    + model_sql.track("(SELECT 'events' AS model, text FROM u)", "u", "user_id", 2, 256)[5:]
)
_SPACED = TEXT_SQL["spacing_variants"].replace("doc_id", "corpus").replace("FROM documents WHERE text IS NOT NULL", f"FROM {_CORPORA} WHERE text IS NOT NULL")
_SPACED = _SPACED[: _SPACED.index(", w AS (SELECT *, list_filter")].replace("WITH b AS", "WITH bare AS").replace("FROM b ", "FROM bare ")
_SPACING_STUDY = (
    _SPACED + ", " + model_sql.track(f"(SELECT corpus AS model, text FROM {_CORPORA})", "(SELECT corpus, spacing, variant AS text FROM v)", "corpus, spacing", 1)[5:]
    + " SELECT corpus, spacing, model, count(*) AS n_symbols, round(sum(bits) / count(*), 4) AS bits_per_symbol FROM track GROUP BY ALL"
)

_W = r"\p{L}\p{M}\p{N}"
_PAIRS = [f"regexp_extract_all(replace(text, chr(31), ' '), '([^{_W}]*)([{_W}]+)', {n})" for n in (1, 2)]
_TOKENS = f"SELECT doc_id, lang, kind, list_transform(generate_series(1, len(t)), lambda i: CASE WHEN i > 1 THEN t[i - 1] || chr(31) || t[i] ELSE t[i] END) AS g FROM (SELECT doc_id, lang, unnest(['w', 'n']) AS kind, unnest([{_PAIRS[1]}, {_PAIRS[0]}]) AS t FROM documents WHERE text IS NOT NULL)"
_WORD_SCORES = (
    f"WITH tk AS (SELECT doc_id, lang, kind, unnest(g) AS gram FROM ({_TOKENS})), gct AS (SELECT lang || chr(31) || kind AS model, gram, count(*) AS n FROM tk WHERE lang IS NOT NULL GROUP BY ALL), "
    + model_sql.from_grams(1, "\x1f", "t")
    + ", lt AS (SELECT DISTINCT model, string_split(gram, chr(31))[-1] || chr(3) AS text FROM gct), "
    + model_sql.model_ctes("lt", 1, "l")
    + ", dt AS (SELECT DISTINCT gram FROM tk), dl AS (SELECT DISTINCT gram FROM (SELECT substr(text, greatest(i - 1, 1)::INT, least(i, 2)::INT) AS gram FROM (SELECT text, unnest(generate_series(1, length(text))) AS i FROM (SELECT DISTINCT string_split(gram, chr(31))[-1] || chr(3) AS text FROM dt)))), "
    + model_sql.bits_cte(1, sep="\x1f", name="t", rest=False)
    + ", "
    + model_sql.bits_cte(1, name="l")
    + ", sp AS (SELECT token, model, sum(bits) AS bits FROM (SELECT token, substr(text, greatest(i - 1, 1)::INT, least(i, 2)::INT) AS gram FROM (SELECT token, text, unnest(generate_series(1, length(text))) AS i FROM (SELECT DISTINCT string_split(gram, chr(31))[-1] AS token, string_split(gram, chr(31))[-1] || chr(3) AS text FROM dt))) JOIN gbl USING (gram) GROUP BY ALL), "
    "ws AS (SELECT doc_id, split_part(gbt.model, chr(31), 1) AS model, count(*) AS tokens, round(sum(gbt.bits + CASE WHEN found THEN 0 ELSE sp.bits END), 3) AS bits FROM tk JOIN gbt ON gbt.gram = tk.gram AND split_part(gbt.model, chr(31), 2) = tk.kind LEFT JOIN sp ON sp.token = string_split(tk.gram, chr(31))[-1] AND sp.model = gbt.model GROUP BY ALL)"
)

_FOUND = (
    f"WITH {model_sql.model_ctes(_LANGS, ORDER)}, e AS (SELECT lang, substr(text, greatest(i - {ORDER}, 1)::INT, least(i, {ORDER + 1})::INT) AS gram FROM (SELECT lang, text, unnest(generate_series(1, length(text))) AS i FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)), f AS (SELECT lang, gram, count(*) AS n FROM e GROUP BY ALL), "
    f"lv AS (SELECT DISTINCT gram, k FROM f, (SELECT unnest(generate_series(0, {ORDER})) AS k) WHERE length(gram) > k), kn AS (SELECT gram, sw.model, max(lv.k) AS found FROM lv JOIN sw ON sw.k = lv.k AND sw.ctx = substr(gram, (length(gram) - lv.k)::INT, lv.k::INT) AND sw.sym = right(gram, 1) JOIN c ON c.model = sw.model AND c.k = sw.k AND c.ctx = sw.ctx AND (c.k = 0 OR c.occurrences >= 2) GROUP BY ALL) "
    ", fo AS (SELECT lang, m.model, coalesce(found, -1)::INT AS found, sum(n)::BIGINT AS n FROM f CROSS JOIN (SELECT DISTINCT model FROM c) m LEFT JOIN kn ON kn.gram = f.gram AND kn.model = m.model GROUP BY ALL)"
)
_ROMANISED = f"(SELECT list_filter(regexp_split_to_array(transliterated_lines, '[{WS_SQL}]+'), lambda w: w <> '') AS w FROM {_LINES} WHERE transliterated_lines IS NOT NULL)"
_HELD = (
    "(SELECT doc_id, text, lang, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 5 AS fold FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)"
)
_SPLIT = f"(SELECT *, CASE WHEN row_number() OVER (PARTITION BY corpus ORDER BY md5('7:' || line_id), line_id) <= floor(count(*) OVER (PARTITION BY corpus) * {{ratio}}) THEN 'test' ELSE 'train' END AS split FROM {_CORPORA} WHERE text IS NOT NULL)"


def _own(source: str, order: int, columns: str, percent: str = "") -> str:
    return "(" + model_sql.track(source, _CORPORA, "corpus", order) + f" SELECT corpus, {columns}, round(sum(bits) / count(*), 4) AS bits_per_symbol FROM track WHERE corpus = model GROUP BY 1)"


_RADIUS = f"{_TRACK}, o AS (SELECT t.doc_id, t.pos, t.bits FROM track t JOIN documents d ON d.doc_id = t.doc_id AND d.lang = t.model), rm AS (SELECT t.doc_id, t.model, round(avg(abs(t.bits - o.bits)), 4) AS absolute, round(avg(t.bits - o.bits), 4) AS signed, round(avg((t.bits + o.bits) / 2), 4) AS radius FROM track t JOIN o USING (doc_id, pos) JOIN documents d ON d.doc_id = t.doc_id WHERE t.model <> d.lang GROUP BY 1, 2)"

SQL = {
    "split_compression": model_sql.track(f"(SELECT corpus AS model, text FROM {_SPLIT.format(ratio=0.2)} WHERE split = 'train')", _SPLIT.format(ratio=0.2), "corpus, split", 1) + " SELECT corpus, split, count(*) AS n_symbols, round(sum(bits) / count(*), 4) AS bits_per_symbol FROM track WHERE corpus = model GROUP BY 1, 2",
    "orders_curve": " UNION ALL ".join("SELECT * FROM " + _own(f"(SELECT corpus AS model, text FROM {_CORPORA})", k, f"{k} AS max_order") for k in range(4)),
    "sizes_curve": " UNION ALL ".join("SELECT * FROM " + _own(f"(SELECT corpus AS model, text FROM {_SPLIT.format(ratio=p / 100)} WHERE split = 'test')", 1, f"{p} AS percent") for p in (10, 25, 50, 100)),
    "radius_by_model": f"{_RADIUS} SELECT * FROM rm",
    "nearest_model": f"{_RADIUS} SELECT doc_id, min(struct_pack(a := absolute, b := model)).b AS by_absolute, min(struct_pack(a := signed, b := model)).b AS by_signed, min(struct_pack(a := radius, b := model)).b AS by_radius FROM rm GROUP BY 1",
    "word_costs": model_sql.track(_LANGS, f"(SELECT DISTINCT word, ' ' || word || ' ' AS text FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '[{WS_SQL}]+'), lambda w: w <> '')) AS word FROM documents WHERE lang = 'en'))", "word", 1) + " SELECT word, model, round(sum(bits), 3) AS bits FROM track GROUP BY 1, 2",
    "found_orders": f"{_FOUND} SELECT * FROM fo",
    "order_codelength": model_sql.track(_LANGS, _DOCS, "doc_id", 1)
    + ", ot AS (SELECT e.doc_id, gb.model, sum(alone) AS symbol_bits, string_agg(CASE WHEN level < 0 THEN '-' ELSE level::VARCHAR END, '' ORDER BY e.i) AS text FROM e JOIN gb USING (gram) JOIN documents d ON d.doc_id = e.doc_id AND d.lang = gb.model GROUP BY 1, 2), "
    + model_sql.model_ctes("ot", 2, "o")
    + ", eo AS (SELECT doc_id, model AS own, substr(text, greatest(i - 2, 1)::INT, least(i, 3)::INT) AS gram FROM (SELECT doc_id, model, text, unnest(generate_series(1, length(text))) AS i FROM ot)), do_ AS (SELECT DISTINCT gram FROM eo), "
    + model_sql.bits_cte(2, 3, name="o").replace("FROM do d", "FROM do_ d")
    + " SELECT ot.doc_id, ot.model, round(b.bits, 3) AS order_bits, round(symbol_bits, 3) AS symbol_bits FROM ot JOIN (SELECT doc_id, sum(bits) AS bits FROM eo JOIN gbo ON gbo.gram = eo.gram AND gbo.model = eo.own GROUP BY 1) b USING (doc_id)",
    "predicted_symbols": f"{_FOUND} SELECT lang, model, round(sum(CASE WHEN found >= {ORDER} THEN n ELSE 0 END) / sum(n), 6) AS longest, round(sum(CASE WHEN found >= 0 THEN n ELSE 0 END) / sum(n), 6) AS found_at_all FROM fo GROUP BY 1, 2",
    "word_order_costs": model_sql.track(f"(SELECT 'm' AS model, array_to_string(w, ' ') AS text FROM {_ROMANISED})", f"(SELECT unnest(['original', 'backwards', 'sorted']) AS word_order, unnest([array_to_string(w, ' '), array_to_string(list_reverse(w), ' '), array_to_string(list_sort(w), ' ')]) AS text FROM {_ROMANISED})", "word_order", 2) + " SELECT word_order, count(*) AS n_symbols, round(sum(bits) / count(*), 4) AS bits_per_symbol FROM track GROUP BY 1",
    "description_length": f"{_TRACK}, m AS (SELECT model, (sum(types) * 32)::BIGINT AS model_bits FROM c GROUP BY 1), o AS (SELECT model, sum(bits) AS bits FROM track JOIN documents USING (doc_id) WHERE lang = model GROUP BY 1) SELECT model, model_bits, round(bits, 2) AS text_bits, round(bits + model_bits, 2) AS total_bits FROM m JOIN o USING (model)",
    "new_words": f"WITH kw AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(text, '[{WS_SQL}]+')) AS word FROM documents WHERE lang = 'en') WHERE regexp_full_match(word, '[a-z]{{2,}}')), pl AS (SELECT word, i, substr(word, i::INT, 1) AS a FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM kw)), "
    "kd AS (SELECT word, i, unnest(string_split(k, '')) AS x FROM pl JOIN (SELECT unnest(['aeiou', 'bdpt', 'ck', 'mn']) AS k) ON contains(k, a)), fr AS (SELECT DISTINCT word, candidate FROM (SELECT word, left(word, (i - 1)::INT) || x || substr(word, (i + 1)::INT) AS candidate FROM kd) WHERE candidate NOT IN (SELECT word FROM kw)), "
    + model_sql.track(_LANGS, "(SELECT DISTINCT candidate, candidate AS text FROM fr)", "candidate", 1)[5:] + ", z AS (SELECT candidate, round(sum(bits), 3) AS bits FROM track WHERE model = 'en' GROUP BY 1) SELECT word, min(struct_pack(a := bits, b := candidate)).b AS new_word, min(bits) AS bits FROM fr JOIN z USING (candidate) GROUP BY 1",
    "held_out_identify": model_sql.track(f"(SELECT f || '|' || lang AS model, text FROM {_HELD}, (SELECT unnest(generate_series(0, 4)) AS f) WHERE f <> fold)", _HELD, "doc_id, lang, fold", 1)
    + ", b2 AS (SELECT doc_id, lang, split_part(model, '|', 2) AS model, sum(bits) AS bits FROM track WHERE split_part(model, '|', 1) = fold::VARCHAR GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bits, model) AS p FROM b2) SELECT doc_id, lang AS label, model AS best, round(bits, 3) AS bits FROM r WHERE p = 1",
    "segmentation_scores": f"WITH g AS (SELECT line_id, regexp_replace(transliterated_lines, '[{JAVA_WS}]+', ' ', 'g') AS gold FROM {_LINES} WHERE transliterated_lines IS NOT NULL), "
    "f AS (SELECT line_id, gold, regexp_replace(replace(gold, ' ', ''), '(?s)(.{5})', '\\1 ', 'g') AS found FROM g), "
    "p AS (SELECT DISTINCT line_id, side, length(replace(left(t, i::INT), ' ', '')) AS place, length(replace(t, ' ', '')) AS whole FROM (SELECT line_id, side, t, unnest(generate_series(1, length(t))) AS i FROM (SELECT line_id, unnest(['f', 'g']) AS side, unnest([found, gold]) AS t FROM f)) WHERE substr(t, i::INT, 1) = ' '), "
    "q AS (SELECT  line_id, place, count(*) FILTER (WHERE side = 'f') AS f, count(*) FILTER (WHERE side = 'g') AS g FROM p WHERE place > 0 AND place < whole GROUP BY 1, 2) "
    'SELECT count(*) FILTER (WHERE f > 0 AND g > 0) AS "both", sum(f)::BIGINT AS found, sum(g)::BIGINT AS gold, coalesce((count(*) FILTER (WHERE f > 0 AND g > 0))::DOUBLE / nullif(sum(g), 0), 0.0) AS recall, coalesce((count(*) FILTER (WHERE f > 0 AND g > 0))::DOUBLE / nullif(sum(f), 0), 0.0) AS precision FROM q',
    "word_codelength": f"{_WORD_SCORES} SELECT * FROM ws",
    "word_identify": f"{_WORD_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bits, model) AS p FROM ws) SELECT doc_id, max(model) FILTER (WHERE p = 1) AS best, max(bits) FILTER (WHERE p = 1) AS best_bits, max(model) FILTER (WHERE p = 2) AS second, max(bits) FILTER (WHERE p = 2) AS second_bits FROM r GROUP BY 1",
    "model_counters": f"WITH {model_sql.model_ctes(_LANGS, ORDER)} SELECT model, k, count(*) AS contexts, count(*) FILTER (WHERE occurrences >= 2 OR k = 0) AS usable, sum(types)::BIGINT AS counters, sum(occurrences)::BIGINT AS symbols FROM c GROUP BY 1, 2",
    "lang_identify": f"{_IDENTIFY} SELECT * FROM li",
    "precision_at_1": f"{_IDENTIFY} SELECT lang, count(*) AS documents, avg((best = lang)::INT::DOUBLE) AS precision FROM li WHERE lang IS NOT NULL GROUP BY 1",
    "confusion_lang": f"{_IDENTIFY} SELECT lang AS gold, best AS predicted, count(*) AS n FROM li GROUP BY 1, 2",
    "spacing_study": _SPACING_STUDY,
    "event_streams": f"{_STREAMS} SELECT user_id, count(*) AS symbols, round(sum(bits), 3) AS bits FROM track GROUP BY 1",
    "relevance_sweep": f"{_SWEEP} SELECT * FROM sw2",
    "relevance_best": f"{_SWEEP}, bs AS (SELECT norm, min(struct_pack(m := -round((recall + precision) / 2, 6), s := symbol_step, t := text_step)) AS b FROM sw2 GROUP BY 1) SELECT norm, -b.m AS break_even, b.s AS symbol_step, b.t AS text_step FROM bs",
    "map_by_column_but_worst": _map_sql("c", "r", "column", 10),
    "map_by_row": _map_sql("r", "c", "row"),
    "matrix_extremes": f"{_MATRIX} SELECT r AS \"row\", min(value) AS least, max(value) AS greatest FROM l GROUP BY ROLLUP (r)",
    "cross_compression": f"{_CROSS} SELECT * FROM x2",
    "distinguishability": f"{_CROSS} SELECT corpus, max(bits_per_symbol) FILTER (WHERE corpus = model) AS own, max(bits_per_symbol) FILTER (WHERE corpus <> model) AS other, round(max(bits_per_symbol) FILTER (WHERE corpus <> model) - max(bits_per_symbol) FILTER (WHERE corpus = model), 4) AS gain, max(bits_per_symbol) FILTER (WHERE corpus = model) < max(bits_per_symbol) FILTER (WHERE corpus <> model) AS prefers_own FROM x2 GROUP BY 1",
    "context_model": f"WITH {_CTX1} SELECT sw.model, sw.k, sw.ctx, sym, n, weight, occurrences, types, mass, below FROM sw JOIN c ON sw.model = c.model AND sw.k = c.k AND sw.ctx = c.ctx",
    "order0_entropy": "WITH f AS (SELECT lang, sym, count(*) AS n FROM (SELECT lang, substr(text, i::INT, 1) AS sym FROM (SELECT lang, text, unnest(generate_series(1, length(text))) AS i FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)) GROUP BY 1, 2), t AS (SELECT lang, sum(n) AS total FROM f GROUP BY 1) SELECT lang, round(sum(-n / total * log2(n / total)), 4) AS entropy FROM f JOIN t USING (lang) GROUP BY 1",
    "codelength_o1": f"{_TRACK} SELECT doc_id, model, round(sum(bits), 3) AS bits, count(*) AS symbols FROM track GROUP BY 1, 2",
    "codelength_o1_no_exclusions": f"WITH {_bits_sql(False)} SELECT doc_id, model, round(sum(bits), 3) AS bits, count(*) AS symbols FROM track GROUP BY 1, 2",
    "lang_identify_o1": f"{_TRACK}, d2 AS (SELECT doc_id, model, sum(bits) AS bits FROM track GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bits, model) AS p FROM d2) SELECT doc_id, max(model) FILTER (WHERE p = 1) AS best, round(max(bits) FILTER (WHERE p = 1), 3) AS best_bits, max(model) FILTER (WHERE p = 2) AS second, round(max(bits) FILTER (WHERE p = 2), 3) AS second_bits FROM r GROUP BY 1",
    "symbol_winner_share": f"{_TRACK}, m AS (SELECT doc_id, pos, min(struct_pack(a := round(bits, 6), b := model)).b AS model FROM track GROUP BY 1, 2) SELECT model, count(*) AS wins, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM m GROUP BY 1",
    "running_entropy": f"{_TRACK}, r AS (SELECT doc_id, model, pos, sum(bits) OVER (PARTITION BY doc_id, model ORDER BY pos) AS s FROM track) SELECT doc_id, model, pos, round(s, 3) AS bits_so_far, round(s / (pos + 1), 4) AS entropy FROM r WHERE (pos + 1) % 500 = 0",
    "divergence_words": f"{_TRACK}, t AS (SELECT doc_id, pos, sym, sum(bits) FILTER (WHERE model = 'ml') AS a, sum(bits) FILTER (WHERE model = 'en') AS b FROM track WHERE model IN ('ml', 'en') GROUP BY 1, 2, 3), w AS (SELECT *, coalesce(sum((sym = ' ')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS word_no FROM t) SELECT doc_id, word_no, round(sum(a), 4) AS bits_a, round(sum(b), 4) AS bits_b, round(sum(a) - sum(b), 4) AS divergence FROM w GROUP BY 1, 2",
    "information_radius": f"{_TRACK}, t AS (SELECT doc_id, pos, sum(bits) FILTER (WHERE model = 'ml') AS a, sum(bits) FILTER (WHERE model = 'ml-latn') AS b FROM track WHERE model IN ('ml', 'ml-latn') GROUP BY 1, 2) SELECT doc_id, round(avg(a), 4) AS entropy_a, round(avg(b), 4) AS entropy_b, round(avg((a + b) / 2), 4) AS radius, round(avg(abs(a - b)), 4) AS absolute, round(avg(a - b), 4) AS signed FROM t GROUP BY 1",
    "line_max_bits": f"{_TRACK} SELECT doc_id, model, round(max(bits), 4) AS max_bits, round(sum(bits), 3) AS bits FROM track GROUP BY 1, 2",
    "probabilities": f"{_TRACK} SELECT doc_id, model, round(avg(pow(2.0, -bits)), 5) AS mean_probability FROM track GROUP BY 1, 2",
    "map_by_column": _map_sql("c", "r", "column"),
    "recall_precision": f"{_GAINS}, {_RP} SELECT threshold, retrieved, hits, round(recall, 6) AS recall, round(precision, 6) AS precision FROM rp",
    "break_even": f"{_GAINS}, {_RP} SELECT round(greatest(max((recall + precision) / 2), 0.0), 6) AS break_even FROM rp",
    "topic_prior": "SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS prior FROM documents WHERE lang IS NOT NULL GROUP BY 1",
    "spacing_preference": f"SELECT run_id, experiment, min(struct_pack(a := bpc, b := spacing)).b AS best, max(struct_pack(a := bpc, b := spacing)).b AS worst, round(max(bpc) - min(bpc), 6) AS range FROM {_SPACING} GROUP BY 1, 2",
    "boundary_understanding": f"WITH r AS (SELECT run_id, experiment, max(bpc) FILTER (WHERE spacing = 'original') AS o, max(bpc) FILTER (WHERE spacing = 'no_spaces') AS n FROM {_SPACING} GROUP BY 1, 2) SELECT experiment, count(*) AS runs, count(*) FILTER (WHERE n - o > 0) AS prefer_original, count(*) FILTER (WHERE n - o > 0.1) AS good, round(avg(n - o), 6) AS mean_gain FROM r WHERE o IS NOT NULL AND n IS NOT NULL GROUP BY 1",
    "best_configuration": f"WITH m AS (SELECT experiment, spacing, round(avg(bpc), 6) AS mean_bpc, count(*) AS runs FROM {_SPACING} GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY mean_bpc, spacing) AS place FROM m",
    "event_bigram_model": "WITH s AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), c AS (SELECT before, event_type, count(*) AS n FROM s WHERE before IS NOT NULL GROUP BY 1, 2) SELECT before, event_type, n, round(-log2((2 * n - 1) / (2 * sum(n) OVER (PARTITION BY before))), 6) AS bits FROM c",
    "parallel_line_ratio": f"{_PAIR} SELECT * FROM q",
    "alignment_measures": f"{_PAIR} {_MEASURES.format(name='bits', c='ratio')} UNION ALL {_MEASURES.format(name='bits_by_symbol', c='ratio_by_symbol')}",
    "lines_above_ratio": f"{_PAIR} SELECT k::DOUBLE AS k, round(avg((ratio > k)::INT), 6) AS share FROM q, (SELECT unnest([1.0, 1.1, 1.25, 1.5, 2.0, 4.0]) AS k) WHERE ratio IS NOT NULL GROUP BY 1",
    "realigned_lines": f"{_PAIR} SELECT * FROM q WHERE floor(ratio) < 2",
}
QUERIES = [
    model_counters, context_model, order0_entropy, codelength_o1, codelength_o1_no_exclusions, lang_identify, lang_identify_o1, word_codelength, word_identify, precision_at_1, confusion_lang, symbol_winner_share, running_entropy, divergence_words, information_radius, line_max_bits,
    probabilities, map_by_column, map_by_column_but_worst, map_by_row, matrix_extremes, relevance_sweep, relevance_best, recall_precision, break_even, topic_prior, spacing_preference, boundary_understanding, best_configuration, event_bigram_model, parallel_line_ratio, alignment_measures, lines_above_ratio, realigned_lines, cross_compression, distinguishability, split_compression, orders_curve, sizes_curve, radius_by_model, nearest_model, word_costs, found_orders, order_codelength, predicted_symbols, word_order_costs, description_length, new_words, spacing_study, event_streams,
    edit_distance_lines, aligned_sentences, segmentation_scores, adaptive_bits, codec_round_trip, segment_lines, decode_keys, correct_lines, mark_languages, markup_statistics, held_out_identify,
]
