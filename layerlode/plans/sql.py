"""SQL of the registered queries for another engine: named subqueries, and those that build on them."""

from __future__ import annotations

from layerlode.functions.text import STOP_WORDS, WORD
from layerlode.operators.prompts import ENGLISH, KINDS

_WORD = WORD.replace("'", "''")
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _grams(prefix: str, source: str, high: int) -> dict[str, tuple[str, tuple[str, ...]]]:
    leads = "".join(f", lead(w, {k}) over p as w{k}, lead(s, {k}) over p as s{k}" for k in range(1, high))
    parts = ["select object_id, w as term from {0} where not s"]
    for k in range(1, high):
        joined = " || ' ' || ".join(["w", *[f"w{i}" for i in range(1, k + 1)]])
        parts.append(f"select object_id, {joined} from {{0}} where w{k} is not null and not s and not s{k}")
    return {
        f"{prefix}_tok": (f"select object_id, unnest(t) as w, generate_subscripts(t, 1) as pos from (select object_id, regexp_extract_all(lower(text), '{_WORD}') as t from {source})", (source,)),
        f"{prefix}_seq": (f"select object_id, w, s{leads} from (select *, w in ({_STOP}) as s from {prefix}_tok) window p as (partition by object_id order by pos)", (f"{prefix}_tok",)),
        f"{prefix}_grams": (" union all ".join(parts).replace("{0}", f"{prefix}_seq"), (f"{prefix}_seq",)),
        f"{prefix}_terms": (
            f"""select cast(row_number() over (order by occurrences desc, term) - 1 as int) as term_id, term, occurrences
            from (select term, count(*) as occurrences from {prefix}_grams group by term having count(*) >= 2 order by occurrences desc, term limit 50000)""",
            (f"{prefix}_grams",),
        ),
        f"{prefix}_counts": (f"select object_id, term_id, count(*) as n from {prefix}_grams join {prefix}_terms using (term) group by object_id, term_id", (f"{prefix}_grams", f"{prefix}_terms")),
        f"{prefix}_classes": (
            f"select layer, cluster, term_id, cast(sum(n) as bigint) as c, sum(ln(1 + n)) as s from {prefix}_counts join assignments using (object_id) where cluster >= 0 group by layer, cluster, term_id",
            (f"{prefix}_counts", "assignments"),
        ),
    }


def _section(title: str, items: str, most: int, separator: str = "; ") -> str:
    return f"case when len(coalesce({items}, [])) > 0 then '{title}: ' || array_to_string({items}[1:{most}], '{separator}') || chr(10) else '' end"


_KIND = "case kind_index " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end"
_REPLY = ENGLISH.reply.replace("'", "''")
_TASK = "'" + ENGLISH.task.replace("{objects}", "documents").replace("{corpus}", "a collection").replace("{kind}", f"' || {_KIND} || '") + f"' || chr(10) || '{_REPLY}'"
_USER = " || ".join(
    [
        f"'{ENGLISH.about}' || chr(10)",
        _section(ENGLISH.keywords, "keyphrases", 32, ", "),
        _section(ENGLISH.major, "major", 16),
        _section(ENGLISH.minor, "minor", 16),
        f"case when layer > 1 then {_section(ENGLISH.other, 'subtopics', 16)} else '' end",
        f"""coalesce(array_to_string(list_transform(exemplars, lambda x: '{ENGLISH.samples}: "' || x || '"' || chr(10)), ''), '')""",
    ]
)

PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "docs": ("select doc_id as object_id, text, lang, source from documents", ()),
    "objects": ("select doc_id as object_id, text, lang, source, cast(embedding as double[]) as v, label from documents join embeddings on vec_id = doc_id % (select max(vec_id) + 1 from embeddings)", ()),
    "assignments": (
        """select object_id, 0 as layer, label as cluster from objects union all select object_id, 1, label // 2 from objects
        union all select object_id, 2, case when label >= 8 then -1 else label // 4 end from objects""",
        ("objects",),
    ),
    **_grams("d4", "docs", 4),
    "sizes": ("select layer, cluster, count(*) as size from assignments where cluster >= 0 group by layer, cluster", ("assignments",)),
    "cells": ("select object_id, unnest(v) as x, generate_subscripts(v, 1) as pos from objects", ("objects",)),
    "centres": ("select layer, cluster, pos, avg(x) as m from assignments join cells using (object_id) where cluster >= 0 group by layer, cluster, pos", ("assignments", "cells")),
    "overall": ("select pos, avg(x) as m from cells group by pos", ("cells",)),
    "far": (
        """select a.layer, a.cluster, object_id, round(1 - sum((x - o.m) * (c.m - o.m)) / (sqrt(sum((x - o.m) * (x - o.m))) * sqrt(sum((c.m - o.m) * (c.m - o.m)))), 6) as distance
        from assignments a join cells using (object_id) join overall o using (pos) join centres c on c.layer = a.layer and c.cluster = a.cluster and c.pos = o.pos
        where a.cluster >= 0 group by a.layer, a.cluster, object_id""",
        ("assignments", "cells", "overall", "centres"),
    ),
    "tops": ("select max(layer) + 1 as top from assignments", ("assignments",)),
    "edges": (
        """select coalesce(p.l, top) as parent_layer, coalesce(p.c, 0) as parent_cluster, child_layer, child_cluster from (
            select lo.layer as child_layer, lo.cluster as child_cluster, min(case when up.layer > lo.layer then {'l': up.layer, 'c': up.cluster} end) as p
            from assignments lo left join assignments up on up.object_id = lo.object_id and up.cluster >= 0 where lo.cluster >= 0 group by lo.layer, lo.cluster), tops""",
        ("assignments", "tops"),
    ),
    "frequent": (
        "select * from (select layer, cluster, term, row_number() over (partition by layer, cluster order by c desc, term) as rank from d4_classes join d4_terms using (term_id)) where rank <= 10",
        ("d4_classes", "d4_terms"),
    ),
    "names": ("select layer, cluster, term as name from frequent where rank = 1", ("frequent",)),
    "below": (
        "select parent_layer as layer, parent_cluster as cluster, parent_layer - child_layer as down, child_layer as l, child_cluster as c, name from edges join names n on n.layer = child_layer and n.cluster = child_cluster",
        ("edges", "names"),
    ),
    "listed": (
        """select layer, cluster, coalesce(list(name order by l desc, c) filter (where down = 1), []) as one, coalesce(list(name order by l desc, c) filter (where down = 2), []) as two,
        coalesce(list(name order by l desc, c) filter (where down > 2), []) as more from below group by layer, cluster""",
        ("below",),
    ),
    "major_minor": ("select layer, cluster, case when len(one) <= 1 then list_concat(one, two) else one end as major, case when len(one) <= 1 then more else two end as minor from listed", ("listed",)),
    "inherited": ("select layer, cluster, any_value(name) as name from below group by layer, cluster having count(*) = 1 and any_value(name) <> ''", ("below",)),
    "levels": (
        "select layer, layer / (select max(layer) from assignments) as detail, cast(round_even(layer / (select max(layer) from assignments) * 6, 0) as int) as kind_index from (select distinct layer from assignments)",
        ("assignments",),
    ),
    "co": (
        "select distinct a.layer, a.cluster, b.cluster as sub_cluster from assignments a join assignments b using (object_id) where a.layer > 0 and b.layer = 0 and a.cluster >= 0 and b.cluster >= 0",
        ("assignments",),
    ),
    "chosen": (
        "select * from (select layer, cluster, object_id, cast(row_number() over (partition by layer, cluster order by md5('s-' || object_id), object_id) as int) as rank from assignments where cluster >= 0)",
        ("assignments",),
    ),
    "samples": ("select layer, cluster, list(text order by rank) as exemplars from chosen join objects using (object_id) where rank <= 3 group by layer, cluster", ("chosen", "objects")),
    "clusters": (
        """select s.layer, s.cluster, size, n.name, k.keyphrases, exemplars, subtopics, major, minor, i.name as inherited, kind_index
        from sizes s left join names n using (layer, cluster) left join (select layer, cluster, list(term order by rank) as keyphrases from frequent group by layer, cluster) k using (layer, cluster)
        left join samples using (layer, cluster)
        left join (select co.layer, co.cluster, list(name order by sub_cluster) as subtopics from co join names m on m.layer = 0 and m.cluster = sub_cluster group by co.layer, co.cluster) u using (layer, cluster)
        left join major_minor using (layer, cluster) left join inherited i using (layer, cluster) join levels using (layer)""",
        ("sizes", "names", "frequent", "samples", "co", "major_minor", "inherited", "levels"),
    ),
    "prompts": (f"select layer, cluster, inherited is not null as skip, coalesce(inherited, {_TASK} || chr(10) || chr(10) || {_USER}) as prompt from clusters", ("clusters",)),
    "topics": ("select c.*, prompt from clusters c join prompts using (layer, cluster)", ("clusters", "prompts")),
}


def query(body: str, *needs: str) -> str:
    """``body`` under the named subqueries that it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for other in PARTS[name][1]:
            add(other)
        order.append(name)

    for name in needs:
        add(name)
    return "with recursive " + ",\n".join(f"{n} as materialized ({PARTS[n][0]})" for n in order) + "\n" + body if order else body
