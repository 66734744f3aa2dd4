"""Text column functions: tokens, snippets, names, character classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the tokenizer.
EN_STOP = ["the", "a", "an", "of", "in", "on", "at", "with", "and", "or", "is", "are", "was", "were", "for", "to", "by", "as", "from", "be", "has", "have", "had", "showing", "photo", "image", "picture", "this", "that", "it", "its", "which", "what", "who", "whom", "whose", "their"]
KO_STOP = ["있는", "있다", "없는", "없다", "하는", "하여", "되는", "되어", "위한", "이것", "그것", "저것", "우리", "그리고", "그러나", "또한", "때문", "경우", "대한", "위하여", "이번", "부터", "까지", "에서", "으로", "에게", "에서도", "및", "등", "등등", "이하", "이상", "관련", "대상", "기관", "사업", "관한"]
STOP_WORDS = [*EN_STOP, *KO_STOP]
TOKEN = "[가-힣]{2,}|[A-Za-z][A-Za-z0-9\\-]{2,}"


def tokens(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Lower-cased tokens without stop words, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), F.lower)
    return F.filter(found, lambda t: ~t.isin(stop))


def bounded_tokens(text: Column) -> Column:
    """Hangul of 2-8, Latin of 3-12 characters, and digit runs."""
    return F.transform(F.regexp_extract_all(text, F.lit("[가-힣]{2,8}|[A-Za-z]{3,12}|[0-9]+"), 0), F.lower)


def chunks(text: Column, size: int = 500, overlap: int = 100) -> Column:
    """Trimmed pieces of ``size`` characters every ``size - overlap``; empty ones dropped."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.filter(F.transform(starts, lambda i: F.trim(F.substring(text, i + 1, F.lit(size)))), lambda t: t != "")


def pages(text: Column, size: int = 1500) -> Column:
    """Virtual pages without overlap; one empty page for no text."""
    text = F.coalesce(text, F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "(?<=[.!?。])\\s+|\\n+"), lambda s: F.trim(s)), lambda s: s != "")


def best_snippet(text: Column, words: Column, width: int = 220) -> Column:
    """The sentence that holds most query words, the first of equals; the head of the text if none holds any."""
    count = lambda s: F.size(F.filter(F.split(F.lower(s), "\\s+"), lambda w: F.array_contains(words, w)))
    scored = F.transform(sentences(text), lambda s, i: F.struct(count(s).alias("n"), (-i).alias("at"), s.alias("s")))
    best = F.array_max(scored)
    return F.substring(F.when(best["n"] > 0, best["s"]).otherwise(text), 1, width)


def clock(seconds: Column) -> Column:
    """M:SS of rounded seconds, H:MM:SS from an hour on; negative and missing ones are 0."""
    s = F.round(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0))).cast("long")
    part = lambda n: F.lpad(n.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), part(m), part(r))).otherwise(F.concat_ws(":", m.cast("string"), part(r)))


def minutes(seconds: Column) -> Column:
    """M:SS of whole seconds; negative ones are 0."""
    s = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    return F.concat_ws(":", F.floor(s / 60).cast("long").cast("string"), F.lpad((s % 60).cast("string"), 2, "0"))


def line_limited(text: Column, request: Column) -> Column:
    """The first non-empty lines of a text, as many as the request asks for (2 to 5)."""
    wanted = F.regexp_extract(request, "([2-5])\\s*줄", 1)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    return F.when((F.trim(text) == "") | (wanted == ""), text).otherwise(F.array_join(F.slice(lines, 1, F.coalesce(F.try_to_number(wanted, F.lit("9")).cast("int"), F.lit(1))), "\n"))


def class_count(text: Column, characters: str) -> Column:
    """Characters of ``text`` in a regex class."""
    return F.length(F.regexp_replace(text, f"[^{characters}]", ""))


def file_key(stem: Column, key: Column) -> Column:
    """Sanitised stem and the first eight hex digits of the key's MD5."""
    return F.concat(F.regexp_replace(stem, "[^0-9A-Za-z가-힣_-]+", "_"), F.lit("__"), F.substring(F.md5(key.cast("binary")), 1, 8))


def luhn(number: Column) -> Column:
    return F.luhn_check(number)


def clean_name(name: Column) -> Column:
    """File name without folder and extension, separators as blanks."""
    stem = F.regexp_replace(F.regexp_extract(name, "([^/]*)$", 1), "\\.[A-Za-z0-9]{1,5}$", "")
    return F.trim(F.regexp_replace(stem, "[_\\-\\s]+", " "))


def title_of(name: Column) -> Column:
    """A file's name as a title: without ending, folder, leftover ``.zip`` and parts in brackets."""
    t = F.replace(F.regexp_replace(name, r"\.[a-zA-Z0-9]{2,4}$", ""), F.lit(".zip"), F.lit(" "))
    t = F.regexp_extract(F.regexp_replace(t, r"\[.*?\]", ""), r"([^/\\]*)$", 1)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def page_starts(length: Column, size: int = 800, overlap: int = 100) -> Column:
    """Starts of a page's chunks, the last one reaching its end. The page has a character at least."""
    step = size - overlap
    return F.sequence(F.lit(0), F.greatest(F.ceil((length - size) / step), F.lit(0)).cast("int") * step, F.lit(step))


def page_starts_compat(length: Column, size: int = 800, overlap: int = 100) -> Column:
    """The same, then one chunk from every later character of the last overlap: the counts of indexes that were built so."""
    starts = page_starts(length, size, overlap)
    tail = F.greatest(length - overlap, F.element_at(starts, -1) + 1)
    return F.concat(starts, F.when(tail < length, F.sequence(tail, F.greatest(length - 1, tail))).otherwise(F.array().cast("array<int>")))


def best_line(text: Column, words: list[str], width: int = 200) -> Column:
    """(line, score, snippet) of the line that holds most words, the first of equals; null if none holds any."""
    lines = F.split(text, "\n")
    score = lambda s: sum((F.lower(s).contains(w).cast("int") for w in words), F.lit(0))
    best = F.array_max(F.transform(lines, lambda s, i: F.struct(score(s).alias("score"), (-i).alias("at"))))
    near = F.filter(F.transform(F.slice(lines, 1 - best["at"], 2), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(best["score"] > 0, F.struct((1 - best["at"]).alias("line"), best["score"].alias("score"), F.substring(F.array_join(near, " "), 1, width).alias("snippet")))


def term_counts(docs, key: str = "doc_id", text: str = "text"):
    """(key, term, w): how often each token occurs, for every document."""
    t = docs.select(key, F.explode(tokens(F.col(text))).alias("term"))
    return t.groupBy(key, "term").agg(F.count("*").cast("double").alias("w"))


#: Signs of script in extracted text; two of them make a line noise.
NOISE = [r"\.[a-zA-Z_$][a-zA-Z0-9_$]*\s*\(", r"\b(?:function|var|let|const|return|typeof)\b", r"[a-zA-Z_$][a-zA-Z0-9_$]*\.[a-zA-Z_$][a-zA-Z0-9_$]*\.[a-zA-Z_$]", r"<[a-zA-Z][^>]{0,80}>", r"\\u[0-9a-fA-F]{4}"]
#: Jamo, Chinese characters, syllables, and scripts that change within a few characters.
JAMO = r"\x{1100}-\x{11FF}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}"
CHINESE = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"
SYLLABLE = r"\x{AC00}-\x{D7A3}"
SWITCH = rf"(?:[{SYLLABLE}]+[A-Za-z\x{{4E00}}-\x{{9FFF}}]+|[A-Za-z\x{{4E00}}-\x{{9FFF}}]+[{SYLLABLE}]+)(?:[A-Za-z\x{{4E00}}-\x{{9FFF}}]+[{SYLLABLE}]+|[{SYLLABLE}]+[A-Za-z\x{{4E00}}-\x{{9FFF}}]+){{2,}}"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_foreign_lines(text: Column) -> Column:
    """The text without the lines that have three Chinese characters or more and no Hangul."""
    keep = F.filter(F.split(text, "\n", -1), lambda x: (class_count(x, SYLLABLE) > 0) | (class_count(x, CHINESE) < 3))
    return _stripped(F.array_join(keep, "\n"))


def looks_like_contents(text: Column) -> Column:
    """No line, up to five short ones, or mostly lines of digits and dots: a table of contents or a heading."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), _stripped), lambda x: x != "")
    total = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x))
    dots = F.size(F.filter(lines, lambda x: x.rlike(r"^[\d\s.\-·…]+$")))
    return (F.size(lines) == 0) | ((F.size(lines) <= 5) & (total < 30 * F.size(lines))) | (2 * dots > F.size(lines))


def garbled(line: Column) -> Column:
    """Loose jamo, more Chinese characters than syllables, or scripts that change three times."""
    jamo, cn = class_count(line, JAMO), class_count(line, CHINESE)
    return ((jamo >= 2) & (jamo >= 0.08 * F.length(line))) | ((cn >= 3) & (cn > class_count(line, SYLLABLE))) | line.rlike(SWITCH)


def clean_lines(text: Column) -> Column:
    """Lines that are no script, markup or garbage; blank ones become empty."""
    noise = lambda x: sum((x.rlike(p).cast("int") for p in NOISE), F.lit(0)) >= 2
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.when(F.trim(x) == "", "").otherwise(x))
    return F.filter(lines, lambda x: (x == "") | ~(noise(_stripped(x)) | garbled(_stripped(x))))


def cleaned(text: Column) -> Column:
    return _stripped(F.regexp_replace(F.array_join(clean_lines(text), "\n"), "\n{3,}", "\n\n"))


def cjk_share(text: Column) -> Column:
    """Share of Chinese characters; 1 for no text."""
    return F.when(F.length(text) > 0, class_count(text, r"\x{4E00}-\x{9FFF}") / F.length(text)).otherwise(1.0)


def clean_caption(text: Column) -> Column:
    """The caption, empty if more than 5 % of it are Chinese, or replaced and control, characters."""
    bad = class_count(text, r"\x{FFFD}\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}")
    return F.when((F.length(text) > 0) & (cjk_share(text) <= 0.05) & (bad <= 0.05 * F.length(text)), text).otherwise("")


def says_something(stem: Column) -> Column:
    """Whether a file's name is more than digits and codes."""
    return ~stem.rlike("^[0-9]+$") & stem.rlike("[가-힣]{2,}|[a-zA-Z]{4,}")


def recording_text(path: Column, name: Column, meta: Column, speech: Column) -> Column:
    """Folder (unless it is a batch's), title, metadata and speech of a segment, what there is of them."""
    folder = F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]*$", 1)
    folder = F.when(~folder.rlike(r"(?i)^[가-힣a-zA-Z0-9]+_(?:[a-zA-Z가-힣0-9]+_)?\d+차?$"), folder)
    some = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.concat_ws(" ", some(folder), some(title_of(name)), some(meta), some(speech))


def name_ngrams(files, least: int = 2, most: int = 50):
    """(g, files) of one to three neighbouring words of stems, of fitting length, that ``least`` to ``most`` files share."""
    words = F.concat(F.regexp_extract_all("stem", F.lit("[가-힣]{2,}"), 0), F.regexp_extract_all("stem", F.lit("[A-Za-z]{2,}"), 0))
    run = lambda w, n: F.transform(F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.lower(F.array_join(F.slice(w, i, F.lit(n)), " ")))
    w = files.select("file_name", words.alias("w"))
    fit = lambda g, lo, hi: F.filter(g, lambda x: F.length(x).between(lo, hi))
    every = F.array_distinct(F.concat(run(F.col("w"), 1), fit(run(F.col("w"), 2), 4, 25), fit(run(F.col("w"), 3), 6, 35)))
    g = w.select("file_name", F.explode(every).alias("g")).distinct().groupBy("g").agg(F.count("*").alias("files"))
    return g.where(F.col("files").between(least, most))


#: Offices that follow names in speech.
OFFICES = ["의장", "대표", "대통령", "박사", "감독", "교수", "장관", "위원", "의원", "소장", "회장", "기자", "작가"]


def office_phrases(rows, key: str, text: str, least: int = 2, most: int = 30):
    """(phrase, files) of a name of two to four syllables and an office behind it."""
    pattern = rf"([가-힣]{{2,4}})\s*({'|'.join(OFFICES)})"
    found = rows.select(key, F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("n"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("o"))).alias("m"))
    phrases = found.select(key, F.concat_ws(" ", "m.n", "m.o").alias("phrase")).groupBy("phrase").agg(F.count_distinct(key).alias("files"))
    return phrases.where(F.col("files").between(least, most))


def snippet_of(own: Column, page: Column, caption: Column) -> Column:
    """A hit's own snippet, else the head of its page's text, else that of its caption's parts."""
    some = lambda c: F.nullif(c, F.lit(""))
    parts = F.filter(F.transform(caption, lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(some(F.trim(own)), some(F.substring(F.trim(page), 1, 800)), some(F.substring(F.array_join(parts, " | "), 1, 600)))


def summary_context(chunks, key: str, order: str, text: str, budget: int = 1200):
    """(key, context) for a summary: a document's chunks in order, each under its number; those that look like a table of contents,
    or start with the same 60 characters as an earlier one, are left out, unless all would be."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    c = chunks.select(key, order, F.trim(text).alias("t"), F.row_number().over(w).alias("i")).where("t != ''").withColumn("toc", looks_like_contents(F.col("t")))
    c = c.withColumn("all_toc", F.min("toc").over(Window.partitionBy(key)))
    head = F.trim(F.substring("t", 1, 60))
    c = c.withColumn("again", F.row_number().over(Window.partitionBy(key, head, "toc").orderBy("i")) > 1).where("all_toc OR (NOT toc AND NOT again)")
    piece = F.concat(F.lit("[문서 "), F.col("i").cast("string"), F.lit("] "), F.col(key), F.lit(":\n"), "t")
    used = F.sum(F.length(piece) + 2).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # only what the budget can hold is put together
    c = c.withColumn("p", piece).withColumn("used", F.coalesce(used, F.lit(0))).where(F.col("used") <= budget)
    t = c.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]), "\n\n").alias("t"))
    return t.select(key, F.when(F.length("t") > budget, F.concat(F.substring("t", 1, budget), F.lit("\n...(이하 생략)"))).otherwise(F.col("t")).alias("context"))


def extract(context: Column, blocks: int = 5, width: int = 120, least: int = 10) -> Column:
    """Of each numbered block the first line of ``least`` characters that is no heading, cut to ``width``; the first ``blocks`` different ones."""
    heading = lambda x: x.endswith(":") & (F.length(x) < 60)
    useful = lambda b: F.get(F.filter(F.transform(F.split(b, "\n", -1), _stripped), lambda x: (F.length(x) >= least) & ~heading(x)), 0)
    lines = F.transform(F.split(context, r"\[문서 \d+\]", -1), lambda b: F.trim(F.substring(useful(b), 1, width)))
    return F.slice(F.array_distinct(F.array_compact(lines)), 1, blocks)


#: Words of a summary, and words of taking texts out.
SUMMARY = ["요약", "정리", "줄거리", "핵심", "3줄", "세줄", "한줄", "summary", "plot"]
TAKING = ["출력", "보여줘", "원문", "전부", "모두", "dump", "export", "all records", "raw data"]


def only_summary(query: Column) -> Column:
    """A request that wants a summary and nothing that takes texts out."""
    has = lambda words: F.greatest(*[F.contains(F.lower(query), F.lit(w)).cast("int") for w in words]) == 1
    return has(SUMMARY) & ~has(TAKING)


def occurrences(text: Column, piece: str) -> Column:
    """How often a piece stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def passage(snippet: Column, speech: Column, caption: Column, name: Column, most: int = 800) -> Column:
    """What a reranker reads of a hit."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.substring(F.coalesce(some(F.trim(snippet)), some(speech), some(caption), name), 1, most)
