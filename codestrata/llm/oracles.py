"""SQL equivalents of the training-data queries that SQL can express."""

MIX = r"""WITH base AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  -ln((('0x' || md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:13])::BIGINT + 0.5) / 4503599627370496.0)
  / (0.05 + length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g')) / greatest(length(coalesce(text, '')), 1)) AS e FROM documents),
own AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight FROM own),
filled AS (SELECT *, 3.0::DOUBLE * source_size AS lim, 3.0::DOUBLE * source_size / weight AS ratio FROM weighed),
levels AS (SELECT *, row_number() OVER o AS place, (sum(source_size) OVER () - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM filled WINDOW o AS (ORDER BY ratio, source IS NULL, source)),
targets AS (SELECT source, source_size, CASE WHEN level > ratio THEN lim ELSE (SELECT arg_min(level, place) FROM levels WHERE level <= ratio) * weight END AS target FROM levels),
shares AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
placed AS (SELECT b.doc_id, b.size::BIGINT AS size, s.source_size, s.target, s.epochs, floor(s.target - s.epochs * s.source_size + 0.5)::BIGINT AS rest,
  (sum(b.size) OVER (PARTITION BY b.source ORDER BY b.e, b.doc_id, b.size ROWS UNBOUNDED PRECEDING) - b.size)::BIGINT AS start FROM base b JOIN shares s ON b.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, rest - start)))::BIGINT AS taken FROM placed"""
