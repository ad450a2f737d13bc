"""Text, link, date and number functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse import views
from tallyhouse.checks.base import M, T, day, r, stamp
from tallyhouse.checks.totals import SQL_WORDS
from tallyhouse.functions import dates as dt
from tallyhouse.functions import registers as rg
from tallyhouse.functions import text as tx
from tallyhouse.functions import urls as ul
from tallyhouse.operators import bins as bn
from tallyhouse.operators import terms as tm
from tallyhouse.plans.register import candidate_table


def _docs(fn, mix=False):
    def query(spark, sf):
        d = T(spark, sf, "documents")
        text = F.concat("text", F.lit(" Ação, São — “ÀÈÌ”! "), "lang") if mix else F.col("text")
        return d.select("doc_id", F.md5(fn(text)).alias("digest"))

    return query


remove_accents = _docs(tx.remove_accents, mix=True)
remove_punctuation = _docs(lambda c: F.concat(tx.remove_punctuation(c), F.lit("|"), tx.remove_punctuation(c, True)), mix=True)
keep_only_letters = _docs(tx.keep_only_letters, mix=True)
_EN = ("the", "of", "and", "in", "is", "on", "it")
remove_stopwords = _docs(lambda c: tx.remove_stopwords(c, _EN))


def text_to_tag(spark, sf):
    n = T(spark, sf, "nation").join(T(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat(F.lit("  São (Paulo):  "), "n_name", F.lit(" / "), "r_name")
    return n.select("n_nationkey", tx.text_to_tag(name).alias("tag"))


def replace_bold_unicode(spark, sf):
    """Documents written in the six styled alphabets and read back."""
    a = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    out = None
    for start in (0x1D5D4, 0x1D400, 0x1D608, 0x1D434, 0x1D63C, 0x1D468):
        styled = "".join(chr(start + i) for i in range(52)).replace(chr(0x1D455), "ℎ")
        part = T(spark, sf, "documents").select("doc_id", F.lit(start).alias("style"), F.translate("text", a, styled).alias("t"), "text")
        out = part if out is None else out.union(part)
    back = tx.replace_bold_unicode(F.col("t"))
    return out.groupBy("style").agg(F.count(F.when(back == F.col("text"), 1)).alias("n_same"), F.sum(F.length(back)).alias("chars"))


def std_string(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", F.concat(F.lit(" \t"), "text", F.lit("  ﬁm ½ \n")).alias("text"))
    return d.select("doc_id", F.md5(tx.std_string(F.col("text"), "lower")).alias("digest"))


def crop_strings(spark, sf):
    t = F.col("text")
    return T(spark, sf, "documents").select("doc_id", tx.crop_strings(t, 0, 400).alias("head"), tx.crop_strings(t, 10, 30, "...").alias("inner"))


def str_join(spark, sf):
    n = T(spark, sf, "nation").withColumn("name", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")))
    return n.select("n_nationkey", tx.str_join([F.col("n_nationkey"), F.col("name"), F.col("n_regionkey")], "/").alias("label"))


def _accounts(spark, sf, host):
    """Page sites as account links in five spellings."""
    p = T(spark, sf, "pages")
    name = F.regexp_replace(F.regexp_extract("url", r"//([^/]+)", 1), r"[.\-]", "_")
    k = F.col("page_id") % 5
    url = (
        F.when(k == 0, F.concat(F.lit(f"https://{host}.com/"), name))
        .when(k == 1, F.concat(F.lit(f"https://www.{host}.com/https://www.{host}.com/"), F.upper(name)))
        .when(k == 2, F.concat(F.lit("@"), name))
        .when(k == 3, F.concat(F.lit(f"www.{host}/stories/" if host == "instagram" else f"www.{host}/"), name))
        .otherwise(F.col("url"))
    )
    return p.select("page_id", url.alias("url"))


def twitter_username(spark, sf):
    u = F.col("url")
    return _accounts(spark, sf, "twitter").select(
        "page_id", ul.twitter_username(u).alias("full"), ul.twitter_username(u, lower=False, repair=False).alias("simple")
    )


def instagram_username(spark, sf):
    return _accounts(spark, sf, "instagram").select("page_id", ul.instagram_username(F.col("url")).alias("name"))


def valid_username(spark, sf):
    return _accounts(spark, sf, "twitter").select(
        "page_id", F.coalesce(ul.valid_username(ul.twitter_username(F.col("url"))), F.lit(False)).cast("int").alias("valid")
    )


_SAMPLES = [*ul.PLATFORMS, "fb", "zap 119", "blogspot.", "link.ee/", "nao tem site", "me@site.org"]


def platform_flags(spark, sf):
    array = F.array(*[F.lit(s) for s in _SAMPLES])
    k = (F.col("page_id") % (2 * len(_SAMPLES))).cast("int")
    mark = F.when(k < len(_SAMPLES), F.concat(F.lit(" "), F.get(array, k))).otherwise("")
    base = F.when(F.col("page_id") % 7 == 0, "@someone").when(F.col("page_id") % 7 == 1, "nothing at all").otherwise(F.col("url"))
    p = T(spark, sf, "pages").select("page_id", F.concat(base, mark).alias("url"))
    return p.select("page_id", *ul.platform_flags(F.col("url")))


def lexicon_match(spark, sf):
    d = T(spark, sf, "documents").withColumn("t", F.regexp_replace("text", " the | une | der ", " L4dr@o LADR@O "))
    hit = tx.lexicon_match(F.col("t")).cast("int")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("n_hit"), r(F.avg(hit)).alias("share"))


def account_features(spark, sf):
    c = T(spark, sf, "customer").join(T(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("created")),
                                      F.col("c_custkey") == F.col("o_custkey"))
    df = rg.account_features(c.withColumn("d", F.concat("c_mktsegment", F.lit(" n1 "), F.col("c_nationkey").cast("string"))),
                             "created", "c_name", "d", "2022-08-18")
    return df.select("c_custkey", r("days_created").alias("days_created"), "digits_name", "digits_desc")


def parse_ptbr_number(spark, sf):
    o = T(spark, sf, "orders")
    text = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return o.select("o_orderkey", r(rg.parse_ptbr_number(F.concat(F.lit(" "), text)), 2).alias("price"))


def month_name_to_num(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMMM").alias("long"), F.upper(F.date_format("o_orderdate", "MMM")).alias("short"))
    return o.select("o_orderkey", dt.month_name_to_num(F.col("long")).alias("long"), dt.month_name_to_num(F.col("short")).alias("short"))


def format_legacy_date(spark, sf):
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 6
    f = lambda p: F.date_format(d, p)
    text = (
        F.when(k == 0, f("ddMMyyyy")).when(k == 1, F.upper(f("dd-MMM-yy"))).when(k == 2, f("dd/MM/yyyy"))
        .when(k == 3, f("ddMMyy")).when(k == 4, F.concat(F.lit("29"), f("MMyyyy"))).otherwise(F.concat(f("dd MM"), f("yyyy")))
    )
    o = T(spark, sf, "orders").select("o_orderkey", text.alias("raw"))
    return o.select("o_orderkey", dt.format_legacy_date(F.col("raw")).alias("date"))


def date_replace(spark, sf):
    o = T(spark, sf, "orders")
    return o.select("o_orderkey", day(dt.date_replace(F.col("o_orderdate"), day=1)).alias("first"),
                    day(dt.date_replace(F.col("o_orderdate"), year=2000, month=1)).alias("january"))


def local_utc(spark, sf):
    return T(spark, sf, "events").select("event_id", stamp(dt.capture_utc(F.col("ts"))).alias("utc"), stamp(dt.local_time(F.col("ts"))).alias("local"))


def parse_mixed_offsets(spark, sf):
    zone = F.when(F.col("event_id") % 2 == 0, "+00:00").otherwise("-03:00")
    e = T(spark, sf, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone).alias("t"))
    return e.select("event_id", stamp(dt.parse_mixed_offsets(F.col("t"))).alias("utc"))


def pad_document(spark, sf):
    p = T(spark, sf, "pages")
    number = F.concat((F.col("page_id") * 37).cast("string"), F.lit(" "), F.col("page_id").cast("string"))
    return p.select("page_id", rg.pad_document(number).alias("padded"), rg.last_path_part(F.col("url")).alias("last"))


def clean_candidates(spark, sf):
    o = T(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "ddMMyyyy").alias("DT_NASCIMENTO"),
        F.when(F.col("o_orderstatus") == "F", "FUNDAMENTAL COMPLETO").when(F.col("o_orderstatus") == "O", "MÉDIO COMPLETO").otherwise("SUPERIOR").alias("DS_GRAU_INSTRUCAO"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(" 7")).alias("NR_TITULO_ELEITORAL_CANDIDATO"),
        F.col("o_custkey").cast("string").alias("NR_CPF_CANDIDATO"), F.lit("1º SUPLENTE SENADOR").alias("DS_CARGO"),
    )
    return rg.clean_candidates(o, {"5": "five"})


def clean_assets(spark, sf):
    o = T(spark, sf, "orders")
    text = F.translate((F.col("o_totalprice") * F.when(F.col("o_orderkey") % 9 == 0, -1).otherwise(1)).cast("decimal(18,2)").cast("string"), ".", ",")
    return rg.clean_assets(o.select("o_orderkey", text.alias("VR_BEM_CANDIDATO")))


def clean_votes(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", (1999 + F.col("o_orderkey") % 10).alias("ANO_ELEICAO"), F.col("o_orderstatus").alias("SG_UF"),
                                      F.lit("71072").alias("SG_UE"), F.lower("o_orderpriority").alias("DS_CARGO"))
    return rg.clean_votes(o)


def clean_voters(spark, sf):
    c = T(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 == 0, "INVÁLIDA").otherwise("SUPERIOR A 79 ANOS").alias("FAIXA_ETARIA"),
        F.when(F.col("c_custkey") % 2 == 0, "NAO INFORMADO").otherwise("FEMININO").alias("SEXO"),
        F.when(F.col("c_custkey") % 2 == 0, "LE E ESCREVE").otherwise("NAO INFORMADO").alias("GRAU_DE_ESCOLARIDADE"))
    return rg.clean_voters(c)


def one_hot(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    df = bn.one_hot(o, ["o_orderpriority", "o_orderstatus"], drop="first")
    return df.toDF(*[c.replace("-", "_").replace(" ", "_") for c in df.columns])


def replicate_rows(spark, sf):
    li = T(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity")
    df = bn.replicate_rows(li, F.col("l_quantity") - 1)
    return df.groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


def bin_prob(spark, sf):
    return views.mentions(spark, sf).groupBy(bn.bin_prob(F.col("hate_score"), 0.1).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def values_to_bins(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("v"))
    a = bn.bin_counts(bn.values_to_bins(c, "v", 12, "label", lower=-500, upper=9000), "label").withColumn("scale", F.lit("linear"))
    b = bn.bin_counts(bn.values_to_bins(c, "v", 6, "label", lower=1, log=True), "label").withColumn("scale", F.lit("log"))
    return a.union(b)


def histogram(spark, sf):
    ev = T(spark, sf, "events")
    a = bn.histogram(ev, "value", 25).withColumn("kind", F.lit("count"))
    df = a.union(bn.histogram(ev, "value", 25, density=True).withColumn("kind", F.lit("density")))
    return df.select("kind", "bin", r("center", 6).alias("center"), r("height", 9).alias("height"), r("error", 9).alias("error"))


def log_plus(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_totalprice").alias("raw"))
    a = bn.log_plus(o, ["o_totalprice"], "auto")
    return bn.log_plus(a, ["raw"], 1, base10=False).select("o_orderkey", r("o_totalprice", 9).alias("auto"), r("raw", 9).alias("natural"))


def encrypt_cols(spark, sf):
    key = "0123456789abcdef"
    columns = ["c_name", "c_mktsegment", "absent"]
    enc = rg.encrypt_cols(T(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), columns, key)
    texts = enc.agg(F.count_distinct("c_mktsegment").alias("n")).scalar()
    return rg.decrypt_cols(enc, columns, key).withColumn("n_texts", texts)


_TERMS = ("the", "and", "une", "der", "las")


def typo_matches(spark, sf):
    return tm.typo_matches(T(spark, sf, "documents"), "doc_id", "text", _TERMS)


def parse_datetimes(spark, sf):
    e = T(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("a"),
                                      F.when(F.col("event_id") % 3 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("b"))
    df = dt.parse_datetimes(dt.parse_datetimes(e, ["a"]), ["b"], "yyyy-MM-dd")
    return df.select("event_id", stamp("a").alias("a"), stamp("b").alias("b"))


def vote_share(spark, sf):
    df = candidate_table(T(spark, sf, "customer"), T(spark, sf, "nation"), T(spark, sf, "orders"), T(spark, sf, "lineitem"))
    return df.select("c_custkey", r(rg.vote_share(F.col("votes"), F.col("voters")), 4).alias("share"))


_MIX = "text || ' Ação, São — “ÀÈÌ”! ' || lang"
_P = tx.PUNCTUATION.replace("'", "''")
_SQ = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_LETTERS = tx.NOT_LETTERS


def _hosts(host):
    third = f"'www.{host}/stories/'" if host == "instagram" else f"'www.{host}/'"
    return f"""WITH n AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '//([^/]+)', 1), '[.\\-]', '_', 'g') AS name FROM pages),
      a AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://{host}.com/' || name
        WHEN 1 THEN 'https://www.{host}.com/https://www.{host}.com/' || upper(name) WHEN 2 THEN '@' || name
        WHEN 3 THEN {third} || name ELSE url END AS url FROM n)"""


def _replaced(expr, repairs):
    for old, new in repairs:
        expr = f"regexp_replace({expr}, '{old}', '{new}', 'g')"
    return expr


def _found(expr, pattern):
    return f"nullif(regexp_extract({expr}, '{pattern.replace('(?U)', '').replace('(?iU)', '(?i)').replace('(?iu)', '(?i)')}', 1), '')"


_TW_FULL = _found(_replaced("url", ul.TWITTER_REPAIRS), ul.TWITTER_FULL)
_NO_LOOK = {n: (p.replace("(?!instala[cç][aã]o|instala[çc][õo]es|intant[âa]ne[ao]|instabio\\.cc)", "")) for n, p in ul.PLATFORMS.items()}
_FLAG_SQL = ", ".join(f"regexp_matches(url, '{p}', 'i')::INT AS \"{n}\"" for n, p in _NO_LOOK.items())
_FLAG_SUM = " + ".join(f'"{n}"' for n in _NO_LOOK)
_SAMPLE_SQL = "[" + ", ".join(f"'{s}'" for s in _SAMPLES) + "]"

QUERIES = {
    "remove_accents": (remove_accents, f"SELECT doc_id, md5(translate({_MIX}, '{tx.ACCENTED}', '{tx.PLAIN}')) AS digest FROM documents"),
    "remove_punctuation": (remove_punctuation, f"""
        SELECT doc_id, md5(translate({_MIX}, '{_P}', '') || '|' || translate({_MIX}, '{_P}', '{' ' * len(tx.PUNCTUATION)}')) AS digest FROM documents"""),
    "text_to_tag": (text_to_tag, f"""
        SELECT n_nationkey, regexp_replace(replace(lower(translate({_SQ.format("'  São (Paulo):  ' || n_name || ' / ' || r_name")},
          '{tx.ACCENTED}', '{tx.PLAIN}')), ' ', '_'), '[.,;!:()/]', '', 'g') AS tag FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "keep_only_letters": (keep_only_letters, f"""
        SELECT doc_id, md5({_SQ.format(f"regexp_replace({_MIX}, '{_LETTERS}', '', 'g')")}) AS digest FROM documents"""),
    "remove_stopwords": (remove_stopwords, f"""
        SELECT doc_id, md5(array_to_string(list_filter(split({_SQ.format('text')}, ' '), lambda t: NOT list_contains({list(_EN)}, t)), ' ')) AS digest FROM documents"""),
    "replace_bold_unicode": (replace_bold_unicode, """
        SELECT unnest([120276, 119808, 120328, 119860, 120380, 119912])::INT AS style, count(*) AS n_same, sum(length(text))::BIGINT AS chars FROM documents"""),
    "std_string": (std_string, """
        SELECT doc_id, md5(lower(trim(regexp_replace(text || ' fim 1⁄2', '\\s+', ' ', 'g')))) AS digest FROM documents"""),
    "crop_strings": (crop_strings, """
        SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '…' ELSE text END AS head,
          '...' || substr(text, 11, 20) || CASE WHEN length(text) > 20 THEN '...' ELSE '' END AS "inner" FROM documents"""),
    "str_join": (str_join, """
        SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey || '/' || n_name || '/' || n_regionkey END AS label FROM nation"""),
    "twitter_username": (twitter_username, _hosts("twitter") + f"""
        SELECT page_id, lower({_TW_FULL}) AS "full", {_found('url', ul.TWITTER_SIMPLE)} AS simple FROM a"""),
    "instagram_username": (instagram_username, _hosts("instagram") + f"""
        SELECT page_id, lower({_found(_replaced('url', ul.INSTAGRAM_REPAIRS), ul.INSTAGRAM)}) AS name FROM a"""),
    "valid_username": (valid_username, _hosts("twitter") + f"""
        SELECT page_id, coalesce(regexp_matches(lower({_TW_FULL}), '^[A-Za-z0-9_]{{1,15}}$'), false)::INT AS valid FROM a"""),
    "platform_flags": (platform_flags, f"""
        WITH u AS (SELECT page_id, trim(CASE page_id % 7 WHEN 0 THEN '@someone' WHEN 1 THEN 'nothing at all' ELSE url END
            || CASE WHEN page_id % {2 * len(_SAMPLES)} < {len(_SAMPLES)} THEN ' ' || {_SAMPLE_SQL}[page_id % {2 * len(_SAMPLES)} + 1] ELSE '' END) AS url FROM pages),
        f AS (SELECT page_id, {_FLAG_SQL}, regexp_matches(url, '{ul.WEBSITE}', 'i') AS w, regexp_matches(url, '{ul.HANDLE}', 'i') AS h FROM u)
        SELECT * EXCLUDE (w, h), ({_FLAG_SUM} = 0 AND w)::INT AS website, ({_FLAG_SUM} = 0 AND NOT w AND h)::INT AS arroba,
          ({_FLAG_SUM} = 0 AND NOT w AND NOT h)::INT AS usuario FROM f"""),
    "lexicon_match": (lexicon_match, f"""
        WITH d AS (SELECT lang, regexp_matches(regexp_replace(text, ' the | une | der ', ' L4dr@o LADR@O ', 'g'), '{"|".join(tx.LEXICON)}', 'i')::INT AS h FROM documents)
        SELECT lang, count(*) AS n, sum(h)::BIGINT AS n_hit, round(avg(h), 8) AS share FROM d GROUP BY 1"""),
    "account_features": (account_features, """
        SELECT c_custkey, round((epoch_us(TIMESTAMP '2022-08-18') - epoch_us(min(o_orderdate))) / 86400000000.0::DOUBLE, 8) AS days_created,
          length(regexp_extract(c_name, '\\d{2,5}'))::INT AS digits_name, length(regexp_extract(c_mktsegment || ' n1 ' || c_nationkey, '\\d{2,5}'))::INT AS digits_desc
        FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name, c_mktsegment, c_nationkey"""),
    "parse_ptbr_number": (parse_ptbr_number, "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders"),
    "month_name_to_num": (month_name_to_num, """
        SELECT o_orderkey, month(o_orderdate)::INT AS "long", month(o_orderdate)::INT AS "short" FROM orders"""),
    "format_legacy_date": (format_legacy_date, """
        WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, strftime(o_orderdate, '%d') AS d, strftime(o_orderdate, '%m') AS m,
          strftime(o_orderdate, '%Y') AS y, year(o_orderdate) AS n FROM orders)
        SELECT o_orderkey, CASE WHEN k = 3 AND m = '19' THEN NULL
          WHEN k = 3 THEN CASE WHEN d = '29' AND m = '02' AND (1900 + n % 100 - 1900) % 4 <> 0 THEN '28' ELSE d END || '/' || m || '/19' || substr(y, 3, 2)
          WHEN k = 1 THEN d || '/' || m || '/19' || substr(y, 3, 2)
          WHEN k = 4 THEN CASE WHEN m = '02' AND (n - 1900) % 4 <> 0 THEN '28' ELSE '29' END || '/' || m || '/' || y
          WHEN k = 5 THEN d || '/' || lpad((substr(m, 1, 1)), 2, '0') || '/' || CASE WHEN (substr(m, 2, 1) || y)::INT > 2100 OR (substr(m, 2, 1) || y)::INT < 1800
            THEN '19' || substr(substr(m, 2, 1) || y, 3) ELSE substr(m, 2, 1) || y END
          ELSE d || '/' || m || '/' || y END AS date FROM o"""),
    "date_replace": (date_replace, """
        SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first, '2000-01-' || strftime(o_orderdate, '%d') AS january FROM orders"""),
    "local_utc": (local_utc, """
        SELECT event_id, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS utc, strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM events"""),
    "parse_mixed_offsets": (parse_mixed_offsets, """
        SELECT event_id, strftime(CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL 3 HOUR END, '%Y-%m-%d %H:%M:%S') AS utc FROM events"""),
    "pad_document": (pad_document, """
        SELECT page_id, CASE WHEN length(n) < 12 THEN lpad(n, 12, '0') ELSE n END AS padded, split(url, '/')[-1] AS last
        FROM (SELECT *, (page_id * 37) || page_id::VARCHAR AS n FROM pages)"""),
    "clean_candidates": (clean_candidates, """
        SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS "DT_NASCIMENTO", CASE o_orderstatus WHEN 'F' THEN 'ENSINO FUNDAMENTAL COMPLETO'
          WHEN 'O' THEN 'ENSINO MÉDIO COMPLETO' ELSE 'SUPERIOR' END AS "DS_GRAU_INSTRUCAO", lpad(o_custkey || '7', 12, '0') AS "NR_TITULO_ELEITORAL_CANDIDATO",
          CASE WHEN o_custkey = 5 THEN 'five' ELSE o_custkey::VARCHAR END AS "NR_CPF_CANDIDATO", '1º SUPLENTE' AS "DS_CARGO" FROM orders"""),
    "clean_assets": (clean_assets, 'SELECT o_orderkey, abs(o_totalprice) AS "VR_BEM_CANDIDATO" FROM orders'),
    "clean_votes": (clean_votes, """
        SELECT o_orderkey, 1999 + o_orderkey % 10 AS "ANO_ELEICAO", o_orderstatus AS "SG_UF",
          CASE WHEN o_orderkey % 10 = 7 THEN o_orderstatus ELSE '71072' END AS "SG_UE", upper(o_orderpriority) AS "DS_CARGO" FROM orders"""),
    "clean_voters": (clean_voters, """
        SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Inválido' ELSE 'Superior a 79 anos' END AS "FAIXA_ETARIA",
          CASE WHEN c_custkey % 2 = 0 THEN 'NÃO INFORMADO' ELSE 'FEMININO' END AS "SEXO",
          CASE WHEN c_custkey % 2 = 0 THEN 'LÊ E ESCREVE' ELSE 'NÃO INFORMADO' END AS "GRAU_DE_ESCOLARIDADE" FROM customer"""),
    "one_hot": (one_hot, "SELECT o_orderkey, (o_orderstatus = 'O')::INT AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INT AS \"o_orderstatus_P\", " + ", ".join(
        f"(o_orderpriority = '{v}')::INT AS \"o_orderpriority_{v.replace('-', '_').replace(' ', '_')}\"" for v in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders"),
    "replicate_rows": (replicate_rows, """
        SELECT l_returnflag, l_linenumber, sum(l_quantity - 1)::BIGINT AS n FROM lineitem WHERE l_quantity > 1 GROUP BY ALL"""),
    "bin_prob": (bin_prob, f"WITH {M} SELECT trunc(hate_score / 0.1::DOUBLE)::INT AS bin, count(*) AS n FROM m GROUP BY 1"),
    "values_to_bins": (values_to_bins, """
        WITH v AS (SELECT greatest(least(c_acctbal, 9000), -500)::DOUBLE AS a, greatest(c_acctbal, 1)::DOUBLE AS b FROM customer WHERE c_custkey % 10 <> 0),
        e AS (SELECT min(a) - 1e-6 AS lo, (max(a) - min(a) + 2e-6) / 12 AS dx, log10(min(b) - 1e-6) AS llo,
          (log10(max(b) + 1e-6) - log10(min(b) - 1e-6)) / 6 AS ldx FROM v)
        SELECT trunc(lo + (ceil((a - lo) / dx) - 0.5) * dx)::BIGINT AS label, count(*) AS n, 'linear' AS scale FROM v, e GROUP BY 1
        UNION ALL SELECT trunc((10 ** (llo + (ceil((log10(b) - llo) / ldx) - 1) * ldx) + 10 ** (llo + ceil((log10(b) - llo) / ldx) * ldx)) / 2)::BIGINT,
          count(*), 'log' FROM v, e GROUP BY 1"""),
    "histogram": (histogram, """
        WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(*)::DOUBLE AS n FROM events),
        c AS (SELECT least(floor((value - lo) / (hi - lo) * 25), 24)::INT AS bin, count(*)::DOUBLE AS k FROM events, e GROUP BY 1),
        g AS (SELECT b::INT AS bin, coalesce(k, 0) AS k, lo, (hi - lo) / 25 AS dx, n FROM e, range(25) t(b) LEFT JOIN c ON c.bin = b)
        SELECT 'count' AS kind, bin, round(lo + (bin + 0.5) * dx, 6) AS center, round(k, 9) AS height, round(sqrt(k * (1 - k / n)), 9) AS error FROM g
        UNION ALL SELECT 'density', bin, round(lo + (bin + 0.5) * dx, 6), round(k / (n * dx), 9), round(sqrt(k * (1 - k / n)) / (n * dx), 9) FROM g"""),
    "log_plus": (log_plus, """
        SELECT o_orderkey, round(log10(1 - (SELECT min(o_totalprice) FROM orders) + o_totalprice), 9) AS auto, round(ln(1 + o_totalprice), 9) AS "natural" FROM orders"""),
    "encrypt_cols": (encrypt_cols, "SELECT c_custkey, c_name, c_mktsegment, (SELECT count(*) FROM customer) AS n_texts FROM customer"),
    "typo_matches": (typo_matches, f"""
        WITH w AS (SELECT unnest({SQL_WORDS.format("lower(strip_accents(text))")}) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM w GROUP BY 1)
        """ + " UNION ALL ".join(f"SELECT '{t}' AS term, token, n FROM c WHERE regexp_matches(token, '{tx.typo_pattern(t)}')" for t in _TERMS)),
    "parse_datetimes": (parse_datetimes, """
        SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d 00:00:00') END AS b FROM events"""),
    "vote_share": (vote_share, """
        WITH v AS (SELECT c_nationkey, count(*) AS voters FROM customer GROUP BY 1),
        w AS (SELECT o_custkey, sum(l_quantity) AS votes FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 GROUP BY 1)
        SELECT c_custkey, round(votes * 1e8 / voters, 4) AS share FROM customer JOIN v USING (c_nationkey) LEFT JOIN w ON c_custkey = o_custkey"""),
}
