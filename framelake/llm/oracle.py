"""DuckDB SQL of the manifest, clustering and substring queries, composed level by level and round by round."""

from __future__ import annotations


def field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def merkle_sql(group_levels: int = 6, top_levels: int = 4) -> str:
    """Enough levels for groups of 16 ** group_levels rows and 16 ** top_levels groups; a lone node stays as it is."""
    parts = ["WITH poly AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i))"]
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])))"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    parts.append(f"leaves AS MATERIALIZED (SELECT doc_id, source, sha256({head} || {field('text')}) AS leaf, sha256({head} || {field(f'(CASE WHEN {crc} % 5 = 0 THEN {low} ELSE text END)')}) AS now FROM documents, poly)")
    parts.append("a0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS row_no FROM leaves)")
    parts.append("g0 AS (SELECT source AS s, i, n, leaf AS h FROM a0)")

    def tower(letter: str, levels: int, group: str) -> None:
        """Per level: runs with their members' digests, and the nodes above."""
        for k in range(levels):
            parts.append(f"{letter}r{k} AS MATERIALIZED (SELECT {group}, i // 16 AS run, any_value(n) AS n, string_agg(h, '' ORDER BY i) AS members FROM {letter}{k} GROUP BY {group}, i // 16)")
            parts.append(f"{letter}{k + 1} AS (SELECT {group}, run AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(members) ELSE members END AS h FROM {letter}r{k})")

    def climb(source: str, letter: str, levels: int, group: str, match: str) -> str:
        """Siblings and the recomputed digest along a tower, for rows with i, n, fold and sib."""
        now = source
        for k in range(levels):
            name = f"{source}_{k}"
            left, right = "substr(members, 1, 64 * (a.i % 16))", "substr(members, 64 * (a.i % 16) + 65)"
            parts.append(f"{name} AS (SELECT a.* EXCLUDE (i, sib, fold), a.i // 16 AS i, CASE WHEN r.n > 1 THEN sib || {left} || {right} ELSE sib END AS sib, CASE WHEN r.n > 1 THEN sha256({left} || fold || {right}) ELSE fold END AS fold FROM {now} a JOIN {letter}r{k} r ON {match} AND a.i // 16 = r.run)")
            now = name
        return now

    tower("g", group_levels, "s")
    parts.append(f"t0 AS MATERIALIZED (SELECT 0 AS one, s AS of, row_number() OVER (ORDER BY CAST(s AS BLOB) NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM g{group_levels})")
    tower("t", top_levels, "one")
    parts.append("c AS (SELECT doc_id, source, leaf, now AS fold, '' AS sib, i, row_no FROM a0)")
    low_end = climb("c", "g", group_levels, "s", "a.source IS NOT DISTINCT FROM r.s")
    parts.append(f"d AS (SELECT x.doc_id, x.leaf, x.fold, x.sib, x.row_no, t0.h AS subroot, t0.i AS i FROM {low_end} x JOIN t0 ON x.source IS NOT DISTINCT FROM t0.of)")
    top_end = climb("d", "t", top_levels, "one", "r.one = 0")
    return ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM {top_end} x, t{top_levels}"


def clustering_sql(k: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024, salt: str = "3:") -> str:
    parts = [f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""]
    parts.append(f"c0 AS MATERIALIZED (SELECT place - 1 AS cluster, v AS c FROM (SELECT v, row_number() OVER (ORDER BY sha256('{salt}' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) AS place FROM kept) WHERE place <= {k})")
    far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT * EXCLUDE place FROM (SELECT r, vec_id, v, cluster, CAST({far} AS BIGINT) AS distance, row_number() OVER (PARTITION BY r ORDER BY {far}, cluster) AS place FROM kept, c{n}) WHERE place = 1)")
        if n < rounds:
            sums = f"SELECT cluster, p, CAST(sum(x) AS HUGEINT) AS s, count(*) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range({dims})) AS p FROM a{n}) GROUP BY cluster, p"
            floor = "CAST(CASE WHEN s < 0 AND s % m <> 0 THEN s // m - 1 ELSE s // m END AS BIGINT)"
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(w.c, o.c) AS c FROM c{n} o LEFT JOIN (SELECT cluster, list({floor} ORDER BY p) AS c FROM ({sums}) GROUP BY cluster) w USING (cluster))")
    parts.append(f"names AS (SELECT cluster, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM c{rounds})")
    return ",\n".join(parts) + f"\nSELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN names USING (cluster)"


def substring_sql(window: int = 50) -> str:
    return rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS MATERIALIZED (SELECT r, doc_id, i, sha256(array_to_string(words[i:i + {window - 1}], ' ')) AS h FROM (SELECT *, unnest(range(1, greatest(len(words) - {window - 2}, 1))) AS i FROM docs)),
least AS (SELECT h, min(doc_id) AS source FROM starts GROUP BY h),
flags AS (SELECT r, i FROM starts JOIN least USING (h) WHERE doc_id > source),
places AS (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM docs),
marked AS (SELECT p.r, p.i, p.words[p.i] AS word, max(CASE WHEN f.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone FROM places p LEFT JOIN flags f ON p.r = f.r AND p.i = f.i),
kept AS (SELECT r, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM marked GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)"""
