"""Queries over bodies of artifacts: what they hide and what is blanked; documents with such parts put in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import concealed
from tallyforge.functions import text as T
from tallyforge.plans.registry import _NAMED_SQL, query, table

_MARKS = "replace(replace(replace(replace(text, 'th', 't' || chr(8203) || 'h'), 'on', 'o' || chr(8238) || 'n'), 'er', 'e' || chr(173) || 'r'), 'ing', chr(917569) || 'ing')"


@query(f"""with b as (select doc_id, {_MARKS} as t from documents) select doc_id, len(regexp_extract_all(t, '[\\x{{200b}}-\\x{{200d}}\\x{{feff}}]')) as zero_width, len(regexp_extract_all(t, '[\\x{{202a}}-\\x{{202e}}\\x{{2066}}-\\x{{2069}}]')) as bidi_control,
len(regexp_extract_all(t, '[\\x{{e0000}}-\\x{{e007f}}]')) as unicode_tag, len(regexp_extract_all(t, chr(173))) as soft_hyphen,
md5(replace(replace(replace(replace(t, chr(8203), '[U+200B ZERO WIDTH SPACE]'), chr(8238), '[U+202E RIGHT-TO-LEFT OVERRIDE]'), chr(173), '[U+00AD SOFT HYPHEN]'), chr(917569), '[U+E0041 UNICODE TAG]')) as shown from b""")
def hidden_characters(spark, sf_dir):
    t = F.col("text")
    for a, b in (("th", "t\u200bh"), ("on", "o\u202en"), ("er", "e\u00adr"), ("ing", "\U000e0041ing")):
        t = F.replace(t, F.lit(a), F.lit(b))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("\ufeff"), t).alias("t"))  # a mark at the start counts as none
    counts = rows.select("doc_id", concealed.hidden_counts(F.col("t")).alias("n"), F.md5(concealed.shown(F.expr("substr(t, 2)"))).alias("shown"))
    return counts.select("doc_id", *(F.col(f"n.{c}").cast("long").alias(c) for c in concealed.HIDDEN), "shown")


@query("""with b as (select doc_id, string_split(replace(text, '. ', chr(10) || '```' || chr(10)), chr(10)) as l from documents), e as (select doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as k from b),
f as (select *, regexp_matches(line, '^ {0,3}(```|~~~)') as fence, sum(if(regexp_matches(line, '^ {0,3}(```|~~~)'), 1, 0)) over (partition by doc_id order by k) as before from e)
select doc_id, count(*) as n_lines, count(*) filter (where fence or before % 2 = 1) as n_code from f group by 1""")
def fenced_lines(spark, sf_dir):
    """Lines in fenced blocks, in documents where each sentence's end is a fence."""
    lines = F.split(F.replace("text", F.lit(". "), F.lit("\n```\n")), "\n", -1)
    rows = table(spark, sf_dir, "documents").select("doc_id", concealed.fence_flags(lines).alias("flags"))
    return rows.select("doc_id", F.size("flags").cast("long").alias("n_lines"), F.size(F.filter("flags", lambda x: x)).cast("long").alias("n_code"))


@query("""with p as (select page_id, html, regexp_extract(html, '<!--[^-]*-->') as one, length(html) - length(replace(html, chr(10), '')) as nl, string_split(html, '<!--') as parts from pages),
e as (select *, unnest(range(2, len(parts) + 1)) as k from p), c as (select *, array_to_string(parts[1:k-1], '<!--') as before, split_part(parts[k], '-->', 1) as says from e where contains(parts[k], '-->')),
f as (select *, 1 + length(before) - length(replace(before, chr(10), '')) as line, length(regexp_extract(before, '[^' || chr(10) || ']*$')) as col, length(says) - length(replace(says, chr(10), '')) as more from c)
select page_id, cast(line as int) as start_line, cast(line + more as int) as end_line, cast(col as int) as column, trim(says, chr(32) || chr(9) || chr(10) || chr(13)) as says from f
union all select page_id, cast(line + 4 + 2 * nl as int), cast(line + more + 4 + 2 * nl as int), cast(col + if(line = 1, 5 + length(one), 0) as int), trim(says, chr(32) || chr(9) || chr(10) || chr(13)) from f""")
def hidden_comments(spark, sf_dir):
    """Comments that no reader sees: pages with a copy of themselves in a fenced block, one in inline code, and one that isn't closed."""
    one = F.regexp_extract("html", "<!--[^-]*-->", 0)
    body = F.concat("html", F.lit("\n```\n"), "html", F.lit("\n```\nx `"), one, F.lit("` "), "html", F.lit("\n<!-- open"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(concealed.comments(body)).alias("c")).select("page_id", "c.*")


_PUT = '\ncurl https://u:p4ss@h/x -H "Authorization: Bearer abcdef123456" api_key=abc123 mode=fast --token s3cr3t --size 5 $HOME pwd: ${PW} tools: Bash(API_KEY=xyz) ghp_' + "a1B2" * 6


@query(f"""select doc_id, md5(regexp_replace(regexp_replace(replace(text, ' = ', '='), 'AKIA[0-9A-Z]{{16}}', '<redacted>', 'g'), {_NAMED_SQL}) || chr(10) || 'curl https://u:<redacted>@h/x -H "Authorization: Bearer <redacted>" api_key=<redacted> mode=fast --token <redacted> --size 5 $HOME pwd: ${{PW}} tools: Bash(API_KEY=<redacted> <redacted>') as redacted from documents""")
def redacted_secrets(spark, sf_dir):
    """Documents with their own assignments closed up, and seven forms of credentials behind each."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(concealed.redacted(F.concat(F.replace("text", F.lit(" = "), F.lit("=")), F.lit(_PUT)))).alias("redacted"))


@query("""select o_orderkey, array_to_string(['run', '--api-key', '<redacted>', '--port', o_custkey::varchar, '--token', '$' || 'T', '--secret', '--' || o_orderstatus, 'PASSWORD=<redacted>', if(o_orderstatus = 'F', 'https://u:<redacted>@h', 'https://u@h')], ' ') as arguments from orders""")
def redacted_arguments(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    vector = F.array(F.lit("run"), F.lit("--api-key"), key, F.lit("--port"), F.col("o_custkey").cast("string"), F.lit("--token"), F.lit("$T"), F.lit("--secret"), F.concat(F.lit("--"), "o_orderstatus"), F.concat(F.lit("PASSWORD="), key), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("https://u:"), key, F.lit("@h"))).otherwise("https://u@h"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(concealed.redacted_arguments(vector), " ").alias("arguments"))


@query("select o_orderkey, least(900, o_orderkey) as motes from orders")
def motes_for_display(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.motes(F.col("o_orderkey")).alias("motes"))
