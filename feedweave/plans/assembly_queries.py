"""Queries of posts put together from what a page shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweave.operators import assembly
from feedweave.plans.catalog import WS_RE, query
from feedweave.plans.context_queries import trim
from feedweave.plans.views import view

LABELS = ", ".join(f"'{x}'" for x in assembly.BUTTONS)
NAMED = "(t = {0} or starts_with(t, {0} || ' ·'))"


@query(f"""select post_id, arg_min(t, place) as message from (select *, {trim('text')} as t from blocks_v where text is not null and not nested and not after_comments and not coalesce(trim(label) in ({LABELS}), false)) where length(t) >= 8
  and not regexp_matches(t, '{assembly.NO_MESSAGE}') and not regexp_matches(t, '{assembly.PICTURE_LABEL}') and not regexp_matches(t, '{assembly.BARE_URL}') and not {NAMED.format("author_name")} group by 1""", "blocks_v")
def primary_messages(spark, sf_dir):
    """The message of each post: the first of its blocks that can be one."""
    return assembly.primary_message(view(spark, sf_dir, "blocks_v", spread="doc_id"))


@query("""select post_id, k is not null as split, array_to_string(l[1:k - 1], chr(10)) as sharer_text, case when k is not null then case when l[k] = author or starts_with(l[k], author || ' ·') then author else other end end as original_author, array_to_string(l[k + 1:], chr(10)) as original_text from (
  select *, list_min(list_filter(range(2, len(l)), lambda i: (l[i] in (author, other) or starts_with(l[i], author || ' ·')) and length(array_to_string(l[1:i - 1], chr(10))) >= 2 and length(array_to_string(l[i + 1:], chr(10))) >= 4)) as k from (
    select *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as l from shares_v))""", "shares_v")
def reshare_splits(spark, sf_dir):
    """Texts of shares cut where a line names an author: what the sharer says, whose words follow, and these."""
    s = assembly.reshare_split(F.col("text"), F.array("author", "other"))
    return view(spark, sf_dir, "shares_v").select("post_id", s.isNotNull().alias("split"), s["sharer_text"].alias("sharer_text"), s["original_author"].alias("original_author"), s["original_text"].alias("original_text"))


def bare(x: str) -> str:
    return f"regexp_replace({x}, '{WS_RE}', '', 'g')"


REPEATS = "(length({0}) >= 20 and (contains({1}, {0}) or (length({1}) >= 20 and contains({0}, {1}))))"
CONTENT = " or ".join(f"contains(href, '{m}')" for m in assembly.CONTENT_LINKS)
OWN = "(contains(href, '//www.facebook.com/') or starts_with(href, '/'))"


@query(f"""select post_id, left(array_to_string(list(line order by late, place, j)[1:3], chr(10)), 500) as attachment from (select post_id, line, late, place, j, row_number() over (partition by post_id, line order by late, place, j) as r from (
    select post_id, place, not content as late, j, u[j] as line from (select *, case when content then not {REPEATS.format(bare("own_text"), bare("text"))} else not {REPEATS.format(bare("own_text"), bare("array_to_string(u, '')"))} and not {REPEATS.format(bare("own_text"), bare("text"))}
        and length(array_to_string(u, chr(10))) >= 40 and not ({OWN} and names_author) end as fits from (select *, {CONTENT} as content,
      list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 2 and not regexp_matches(x, '{assembly.NO_ATTACHMENT}') and not regexp_matches(x, '{assembly.BARE_URL}')) as u from attached_v where shown and not after_comments and href is not null)),
    lateral (select unnest(range(1, len(u) + 1)) as j) where fits)) where r = 1 group by 1""", "attached_v")
def attachment_lines(spark, sf_dir):
    """What a post attaches, in up to three lines of its links."""
    return assembly.attachments(view(spark, sf_dir, "attached_v", spread="doc_id"))


SPLIT = "case when not quiet and starts_with(whole, 'said of it' || chr(10)) and list_contains(reshare_authors, 'Page A') then 'Page A' end"
CARD_SAYS = REPEATS.format(bare("card_text"), bare("whole"))


def low(x: str) -> str:
    return f"lower({bare(x)})"


@query(f"""select post_id, author_name = '' and trim(text) = '' and coalesce(trim(shared), '') = '' and not has_media as skipped, text, author_name, content_kind, shared as shared_attachment, original as reshare_text,
    coalesce(case when card_text <> '' then card_author end, gql_reshare_author, split, case when alone then reshare_authors[1] end) as reshare_author, is_sponsored, is_recommended, contains(raw_author, 'Verified') as is_verified,
    case when length(gql_text) > length(dom_text) + 50 then 'expanded_or_upgraded' end as completeness, length(whole)::int as classified_units from (
  select *, case when alone then '' when content_kind = 'standard' then whole when split is not null then 'said of it' else whole end as text, case when alone then coalesce(original, seen) else seen end as shared from (
    select *, content_kind = 'share_without_comment' as alone, coalesce(gql_reshare_text, card_text, case when split is not null then substr(whole, length('said of it') + length('Page A') + 3) end) as original from (
      select *, case when coalesce(seen <> '' and (length({low("whole")}) <= 1 or contains({low("whole")}, {low("seen")}) or contains({low("seen")}, {low("whole")})), false) or coalesce(card_text <> '' and (trim(whole) = '' or {CARD_SAYS}), false) or (told and length(trim(whole)) <= 1) then 'share_without_comment'
          when told or split is not null or card_text <> '' then 'reshare_with_comment' else 'standard' end as content_kind from (
        select *, case when not quiet then attachment end as seen, {SPLIT} as split, coalesce(gql_type = 'reshare' and gql_reshare_text <> '', false) as told from (
          select *, coalesce(nullif(gql_author, ''), trim(replace(raw_author, 'Verified', ''))) as author_name, trim(coalesce(nullif(gql_text, ''), dom_text)) as whole, coalesce(gql_sponsored, false) or marked_sponsored or known_sponsored as is_sponsored,
            recommended and not (coalesce(gql_sponsored, false) or marked_sponsored or known_sponsored) as is_recommended, recommended and not (coalesce(gql_sponsored, false) or marked_sponsored or known_sponsored) and not coalesce(gql_type = 'reshare', false) as quiet from assembly_v)))))""", "assembly_v")
def posts_assembled(spark, sf_dir):
    """Posts from what the page shows and what the network says of them."""
    return assembly.assembled(view(spark, sf_dir, "assembly_v", spread="doc_id"))
