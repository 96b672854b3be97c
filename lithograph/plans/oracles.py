"""SQL of the named queries, for comparison on another engine over the same tables."""

from __future__ import annotations

VECTORS = """vec as (select cast(label as varchar) as image_id, embedding, row_number() over (partition by label order by vec_id) - 1 as y from embeddings),
pix as (select image_id, y, cast(i // 4 as integer) as x, cast(i % 4 as integer) as band,
  greatest(0, least(4095, cast(floor((cast(embedding[i + 1] as double) + 1) * 2048) as integer))) as dn from vec, range(64) r(i)),
color as (select * from pix where band < 3)"""
HIST = VECTORS + """, hist as (select image_id, band, dn as bin, count(*) as cnt from color group by all)"""
BOUNDS = HIST + """, summed as (select image_id, band, bin, sum(cnt) over (partition by image_id, band order by bin) as below, sum(cnt) over (partition by image_id, band order by bin desc) as above from hist where bin > 0),
tot as (select image_id, band, sum(cnt) as n, sum(case when bin = 0 then cnt else 0 end) as zeros from hist group by all),
tries(k, low, high) as (values (0, 0.005e0, 0.005e0), (1, 0.0025e0, 0.0025e0), (2, 0.00125e0, 0.00125e0), (3, 0.000625e0, 0.000625e0), (4, 0.0003125e0, 0.0003125e0), (5, 0e0, 0e0)),
quota as (select t.image_id, t.band, k, low, high, floor(low * (f.n - t.zeros)) as lq, floor(high * (f.n - t.zeros)) as hq from tot t join tot f on t.image_id = f.image_id and f.band = 0, tries),
reached as (select q.image_id, q.band, k, low, high, lq, hq, min(case when below >= lq then bin end) as il, max(case when above >= hq then bin end) as ih from quota q left join summed s on q.image_id = s.image_id and q.band = s.band group by all),
ends0 as (select image_id, k, low, high, case when max(lq) > 0 then min(case when lq <= 0 then 1 else coalesce(il, 4095) end) else 0 end + 0e0 as a,
  case when max(hq) > 0 then max(case when hq <= 0 then 4095 else coalesce(ih, 1) end) else 4095 end + 0e0 as b from reached group by all),
ends1 as (select image_id, k, low, high, case when low = 0 and high = 0 then 0e0 when a = b and a >= 1 then a - 1 else a end as lo, case when low = 0 and high = 0 then 4095e0 when a = b and a < 1 then b + 1 else b end as hi from ends0),
bounds as (select image_id, min(k) as k, arg_min(lo, k) as lo, arg_min(hi, k) as hi from ends1 where hi > lo or (low = 0 and high = 0) group by image_id)"""
CELLS = """cells as (select l_orderkey % 64 as x, l_orderkey // 64 as y, l_linenumber - 1 as band, max(cast(floor(l_extendedprice) as bigint)) as dn from lineitem group by all)"""
IMAGES = """img as (select cast(o_orderkey as varchar) as image_id, cast(floor(o_totalprice) as bigint) % 3000 + 1 as width, o_custkey % 2000 + 1 as height from orders)"""
LEVELS = (
    IMAGES
    + """, tops as (select *, case when greatest(width, height) <= 1 then 0 else length(ltrim(bin(greatest(width, height) - 1), '0')) end as top from img),
lev as (select image_id, cast(l as integer) as level, (width + (1::bigint << (top - l)::integer) - 1) // (1::bigint << (top - l)::integer) as w, (height + (1::bigint << (top - l)::integer) - 1) // (1::bigint << (top - l)::integer) as h from tops, range(13) r(l) where l <= top),
levels as (select *, (w + 253) // 254 as cols, (h + 253) // 254 as rows from lev)"""
)
URLS = r"""shaped as (select page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') as bare, url as u from pages),
urls as (select page_id, case page_id % 8 when 0 then 's3://' || bare || '.IMG' when 1 then bare || '.VIC?v=1' when 2 then 'file://' || bare || '.png' when 3 then '/' || bare || '.tif'
  when 4 then 'http://10.0.' || (page_id % 200) || '.7/a.img' when 5 then 'https://b.s3.us-west-2.amazonaws.com/' || bare || '.img' when 6 then bare || '/../x.jpg' else u end as url from shaped),
parts as (select page_id, url, regexp_extract(url, '^([^?#]*)', 1) as path, lower(regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '[.]([^./]+)$', 1)) as ext from urls)"""
REQUESTS = """req as (select o_orderkey, sha1('file://' || o_custkey) as cache_hash, o_orderdate as requested, cast(floor(o_totalprice) as bigint) as cost, o_custkey from orders)"""
TASKS = """task as (select sha1('file://' || c_custkey) as cache_hash, c_custkey % 5 = 0 as finished, c_custkey % 7 = 0 as error, case when c_custkey % 4 > 0 then 1700000000 + c_custkey * 17 % 7000 end as started, case when c_custkey % 3 > 0 then 1700000000 + c_custkey * 31 % 7000 end as progressed, case when c_custkey % 11 > 0 then 1700000000 + c_custkey * 13 % 7000 end as modified from customer)"""
LABELS = """lab as (select cast(event_id as varchar) as path, event_id, user_id, event_type from events),
item as (select path, unnest([
  {pos: 1, name: 'FORMAT', kind: 'string', s: 'HALF', i: null::bigint, d: null::double, n: null::integer, section: 'system', title: '', number: 0},
  {pos: 2, name: 'NL', kind: 'int', s: null, i: user_id % 900 + 1, d: null, n: null, section: 'system', title: '', number: 0},
  {pos: 3, name: 'GAIN', kind: 'double', s: null, i: null, d: ((event_id % 50) || '.5')::double * 10, n: null, section: 'system', title: '', number: 0},
  {pos: 4, name: 'PROPERTY', kind: 'string', s: upper(event_type), i: null, d: null, n: null, section: 'property', title: upper(event_type), number: 1},
  {pos: 5, name: 'NAME', kind: 'string', s: 'it''s ' || event_type, i: null, d: null, n: null, section: 'property', title: upper(event_type), number: 1},
  {pos: 6, name: 'SIZES', kind: 'list', s: null, i: null, d: null, n: 3, section: 'property', title: upper(event_type), number: 1},
  {pos: 7, name: 'TASK', kind: 'string', s: 'T' || (event_id % 4), i: null, d: null, n: null, section: 'task', title: 'T' || (event_id % 4), number: 2},
  {pos: 8, name: 'USER', kind: 'string', s: 'u' || user_id, i: null, d: null, n: null, section: 'task', title: 'T' || (event_id % 4), number: 2}], recursive := true) from lab)"""
DOWN = CELLS + """, s0 as (select y, x, band, dn from cells),
s1 as (select y // 2 as y, x // 2 as x, band, sum(dn)::bigint // count(*) as dn from s0 group by all),
s2 as (select y // 2 as y, x // 2 as x, band, sum(dn)::bigint // count(*) as dn from s1 group by all),
s3 as (select y // 2 as y, x // 2 as x, band, sum(dn)::bigint // count(*) as dn from s2 group by all)"""

SQL = {
    "apply_stretch": f"with {BOUNDS} select c.image_id, band, case when dn <= lo then 0 when dn >= hi then 255 else greatest(0, least(255, cast(trunc((dn - lo) * 255 / (hi - lo)) as integer))) end as out, count(*) as n from color c join bounds b on c.image_id = b.image_id group by all",
    "drop_alpha": f"with {VECTORS} select image_id, band, count(*) as n, cast(sum(dn) as bigint) as s from color group by all",
    "band_extrema": "select 'measures' as image_id, band, min(dn) + 0.0e0 as mn, max(dn) + 0.0e0 as mx from (select 'l_quantity' as band, l_quantity + 0.0e0 as dn from lineitem union all select 'l_extendedprice', l_extendedprice + 0.0e0 from lineitem union all select 'l_discount', l_discount + 0.0e0 from lineitem union all select 'l_tax', l_tax + 0.0e0 from lineitem) group by band",
    "extrema_repair": """with raw as (select n_name as image_id, cast(n_nationkey % 3 as integer) as band, case when n_nationkey % 4 = 0 then null when n_nationkey % 4 = 1 then 50e0 else n_nationkey::double end as mn, case when n_nationkey % 5 = 0 then null else n_nationkey * 2e0 end as mx from nation),
fixed as (select image_id, band, case when mn is null and mx is null then 0e0 when mn is null then mx - 100 else mn end as mn, case when mn is null and mx is null then 0e0 when mx is null then mn + 100 else mx end as mx from raw)
select image_id, band, case when mn > mx then mx - 100 else mn end as mn, mx from fixed""",
    "global_extrema": f"with {VECTORS} select image_id, min(dn) as mn, max(dn) as mx from pix group by image_id",
    "band_histogram": f"with {CELLS} select 'lineitem' as image_id, band, cast(floor(dn * 4096 / 131072) as integer) as bin, count(*) as cnt from cells where dn >= 0 and dn < 131072 group by all",
    "float_histogram": "with e as (select event_type as image_id, min(value) as lo, (max(value) + 1e-6 - min(value)) / 64 as width from events group by 1) select image_id, least(63, cast(floor((value - lo) / width) as integer)) as bin, count(*) as cnt from events join e on event_type = image_id group by all",
    "histogram_zero_filled": f"with {VECTORS}, h as (select image_id, band, dn // 16 as bin, count(*) as cnt from color group by all) select image_id, band, 256::bigint as bins, cast(sum(cnt) as bigint) as cnt, 256 - count(*) as empty from h group by all",
    "extrema_from_histogram": f"with {VECTORS} select image_id, band, min(dn // 4) * 4.0e0 as mn, max(dn // 4) * 4.0e0 as mx from color group by all",
    "percent_stretch_bounds": f"with {BOUNDS} select * from bounds",
    "relative_stretch_bounds": f"with {VECTORS} select image_id, min(dn) * 0.9e0 as lo, max(dn) * 0.75e0 + (1 - 0.75e0) * 4095.0e0 as hi from color group by image_id",
    "literal_stretch_bounds": f"with {VECTORS} select distinct image_id, 0e0 as lo, 3000e0 as hi from color",
    "srgb_lut": f"""with {VECTORS}, held as (select dn // 16 as dn, count(*) as n from color group by 1) select cast(dn as integer) as dn, n, cast(trunc(greatest(0e0, least(1e0, case when dn / 255e0 < 0.0031308e0 then dn / 255e0 * 12.92e0 else pow(dn / 255e0, 1 / 2.4e0) * 1.055e0 - 0.055e0 end)) * 255) as integer) as srgb,
cast(trunc(greatest(0e0, least(1e0, case when dn / 255e0 <= 0.04045e0 then dn / 255e0 / 12.92e0 else pow((dn / 255e0 + 0.055e0) / 1.055e0, 2.4e0) end)) * 255) as integer) as linear from held""",
    "gamma_modes": """with n as (select n_name, case n_nationkey % 4 when 1 then 1e0 when 2 then 0.4501e0 when 3 then 2.2e0 end as gamma, n_nationkey % 5 > 0 as pds, case when n_nationkey % 3 = 0 then 'jpg' else 'png' end as fmt from nation),
c as (select *, pds and (gamma is null or gamma = 1) as linear, pds and gamma is not null and abs(gamma - 0.45) < 0.01 as srgb from n), k as (select *, pds and not linear and not srgb as general from c),
f as (select n_name, m as gamma_mode, fmt, linear, case when linear then 'linear' when srgb then 'srgb' when general then 'general' else 'none' end as gamma_class,
 case m when 'convert' then srgb or general when 'srgbtolinear' then true else false end as a, case m when 'convert' then srgb or general or linear when 'lineartosrgb' then true else false end as b, case m when 'passthrough' then linear when 'srgbtolinear' then true else false end as o
 from k, (values ('none'), ('passthrough'), ('convert'), ('lineartosrgb'), ('srgbtolinear')) v(m))
select n_name, gamma_mode, gamma_class, cast(a as integer) as srgb_to_linear, cast(b as integer) as linear_to_srgb, cast(o as integer) as output_linear, case when o and fmt = 'png' then 'linear' else 'srgb' end as tile_header_gamma, case when (linear and not b) or o then 'linear' else 'srgb' end as tile_data_gamma from f""",
    "mono_to_rgb": f"with {VECTORS} select image_id, cast(sum(3 * dn) as bigint) as s from color where band = 0 group by image_id",
    "pack_argb": f"with {VECTORS}, w as (select image_id, y, x, max(case when band = 0 then dn end) as r, max(case when band = 1 then dn end) as g, max(case when band = 2 then dn end) as b, max(case when band = 3 then dn end) as a from pix group by all), v as (select image_id, y, x, (cast(trunc(255 * a / 4095.0e0) as bigint) << 24) | ((r // 16)::bigint << 16) | ((g // 16)::bigint << 8) | (b // 16)::bigint as u from w) select image_id, y, x, cast(case when u >= 2147483648 then u - 4294967296 else u end as integer) as argb from v",
    "mask_pixels": f"with {VECTORS} select image_id, y, x from color group by all having bool_and(dn % 3 = 0 or dn % 3 = case when band = 1 then 2 else 1 end)",
    "masked_count": f"with {VECTORS}, p as (select image_id, y, x, bool_and(dn % 3 = 0 or dn % 3 = case when band = 1 then 2 else 1 end) as m from color group by all) select image_id, count(*) filter (where m) as masked, count(*) as pixels from p group by image_id",
    "mask_alpha": f"with {VECTORS}, w as (select image_id, y, x, max(case when band = 0 then dn end) as r, max(case when band = 3 then dn end) as a from pix group by all) select image_id, y, x, cast(trunc((a // 16) / 255.0e0 * case when r % 3 = 1 then 0.25e0 else 0.75e0 end * 255) as integer) as alpha from w",
    "threshold_combine": f"with {VECTORS}, p as (select image_id, y, x, least(255, sum(case when dn // 16 between 120 and 128 then 0 else dn // 16 end)) as v from color group by all) select image_id, cast(v as integer) as v, count(*) as n from p group by all",
    "crop_rect": f"with {CELLS} select y, x, band, dn from cells where x between 8 and 27 and y between 4 and 13",
    "limit_height": f"with {CELLS} select band, count(*) as n, max(y) as last from cells where y < 12 group by band",
    "invalid_values_distinct": """with h as (select n_name as image_id, list_sort(list_distinct(list_concat([(n_nationkey % 3)::double, -32768e0, 0e0], case when n_nationkey % 2 = 0 then [1e0, 2e0] else []::double[] end))) as v from nation) select image_id, array_to_string(list_transform(v, lambda x: x::varchar), ';') as invalid, cast(len(v) as integer) as n from h""",
    "pyramid_levels": f"with {LEVELS} select image_id, level, w, h, cols, rows from levels",
    "tiles_per_level": f"with {LEVELS} select image_id, level, cols * rows as tiles from levels",
    "tile_rects_overlap": f"""with {LEVELS}, t as (select image_id, level, c as col, r as row, w, h, c * 254 - (c > 0)::integer as x, r * 254 - (r > 0)::integer as y from levels, range(12) a(c), range(12) b(r) where c < cols and r < rows)
select image_id, level, col, row, x, y, least(254 + case when col = 0 then 1 else 2 end, w - x) as tw, least(254 + case when row = 0 then 1 else 2 end, h - y) as th from t""",
    "single_tile_level": f"with {LEVELS} select image_id, max(level) as level from levels where cols * rows = 1 group by image_id",
    "first_fitting_level": f"""with {LEVELS}, m as (select image_id, max(level) as top, max(w) as fw, max(h) as fh from levels group by 1),
t as (select l.image_id, level, top, fw, fh, least(255, w) * (1::bigint << (top - level)::integer) as cw, least(255, h) * (1::bigint << (top - level)::integer) as ch, floor(sqrt(fw * fh * 0.1e0)) as side from levels l join m on l.image_id = m.image_id)
select image_id, cast(coalesce(min(case when least(cw, fw) <= side and least(ch, fh) <= side then level end), max(top) + 1) as integer) as level from t group by 1""",
    "pyramid_downsample": f"with {DOWN} select 'lineitem' as image_id, step, y, x, band, dn from (select 0 as step, * from s0 union all select 1, * from s1 union all select 2, * from s2 union all select 3, * from s3)",
    "pixel_tiles": f"with {CELLS}, p as (select distinct x, y from cells) select c as col, r as row, count(*) as n from p, range(4) a(c), (select distinct unnest([greatest(0, cast(floor((y - 1) / 16) as bigint)), (y + 1) // 16]) as r from p) b where x between c * 16 - 1 and c * 16 + 16 and y between r * 16 - 1 and r * 16 + 16 group by all",
    "window_lookup": """with q as (select o_orderkey as rect_id, o_custkey * 7 % 4000 as x, o_orderkey * 11 % 4000 as y, o_custkey % 900 + 1 as w, o_orderkey % 700 + 1 as h from orders)
select rect_id, a as wx, b as wy, greatest(x, a * 512) as px, greatest(y, b * 512) as py, least(x + w, a * 512 + 512) - greatest(x, a * 512) as pw, least(y + h, b * 512 + 512) - greatest(y, b * 512) as ph from q, range(10) r(a), range(10) s(b) where x < a * 512 + 512 and x + w > a * 512 and y < b * 512 + 512 and y + h > b * 512""",
    "thumb_dims": f"with {IMAGES}, s as (select *, least(width, 254) as sw, least(height, 254) as sh from img), t as (select *, greatest(1, least(160, sh, height)) as h from s), u as (select *, greatest(1, cast(floor(h * (width / height) + 0.5) as bigint)) as w from t) select image_id, least(w, sw) as tw, case when w > sw then cast(floor(sw / (width / height)) as bigint) else h end as th from u",
    "url_filter": rf"""with {URLS} select page_id, case when url like '%../%' then 'dotdot' when page_id % 8 = 4 then 'unsafe_host'
when not (regexp_full_match(url, '(?i)(s3|https)://.*') or regexp_full_match(url, '[^/].*')) then 'not_whitelisted'
when not regexp_matches(url, '^(?i)(https?|s3)://') and regexp_replace(url, '^(?i)file://', '') like '/%' then 'absolute_path' when url like '%/a/%' then 'ignored_subdir' when regexp_full_match(url, '.*/quick.*') then 'ok'
when ext not in ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'img', 'vic') then 'unsupported_ext' else 'ok' end as reason from parts""",
    "url_parts": rf"""with {URLS} select page_id, cast(ext in ('img', 'vic') as integer) as is_pds, regexp_replace(path, '[.][^./]*$', '') || '.png' || substr(url, length(path) + 1) as as_png, regexp_replace(url, '^(?i)file://', '') as stripped, list_extract(string_split(url, '/'), -1) as filename from parts""",
    "cache_hash": rf"""with {URLS}, one as (select page_id, case when ext in ('img', 'vic') then regexp_replace(path, '[.][^./]*$', '') || '.IMG' || substr(url, length(path) + 1) else url end as u from parts),
canon as (select page_id, case when u like 'https://b.s3.%' then 's3://b/' || regexp_replace(u, '^https://[^/]+/', '') else u end as u from one) select page_id, sha1(case when regexp_matches(u, '^(?i)(https?|s3|file)://') then u else 'file://' || u end) as cache_hash from canon""",
    "ssrf_ipv4": "with a as (select o_orderkey, o_orderkey % 256 as a, o_custkey % 256 as b, o_orderkey % 7 as c from orders) select o_orderkey, cast(not (a in (0, 10, 127) or a >= 224 or (a = 100 and b between 64 and 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 0 and c = 0) or (a = 192 and b = 168) or (a = 198 and b in (18, 19))) as integer) as safe from a",
    "size_units": """with b as (select n_nationkey, n_nationkey::bigint * case n_nationkey % 4 when 0 then 1024 when 1 then 1048576 when 2 then 1073741824 else 1 end as bytes, n_nationkey * case n_nationkey % 3 when 0 then 1 when 1 then 60 else 3600 end as seconds from nation)
select n_nationkey, cast(bytes as bigint) as bytes, cast(seconds as bigint) as seconds, case when bytes < 1024 then bytes::varchar when bytes < 1048576 then printf('%.1fk', bytes / 1024e0) when bytes < 1073741824 then printf('%.1fM', bytes / 1048576e0) else printf('%.1fG', bytes / 1073741824e0) end as shown from b""",
    "spec_defaults": """with c as (select c_custkey, case when c_custkey % 3 = 0 then c_custkey % 500 - 100 end as t, case when c_custkey % 2 = 0 then (c_custkey % 150)::double end as l from customer),
r as (select c_custkey, cast(case when t > 0 then t else 254 end as integer) as tile_size, case when l between 0 and 100 then l else 0.5e0 end as stretch_low from c) select *, cast(tile_size = 254 and stretch_low = 0.5e0 as integer) as nominal from r""",
    "sol_range": "select cast(min(o_orderkey % 700 + 50) as integer) as min_sol, cast(max(o_orderkey % 700 + 50) as integer) as max_sol from orders",
    "sol_decode": "select p_partkey, cast(case when p_partkey % 3 = 0 then p_partkey % 366 else p_partkey % 1700 end as integer) as sol, cast(p_partkey % 3 = 0 as integer) as doy, cast(case when p_partkey % 3 = 0 then 2017 + p_partkey % 8 end as integer) as year from part",
    "catalog_by_sol": "select o_orderkey, o_custkey from orders where o_orderkey % 700 = 51",
    "edr_rdr_join": "select o_orderkey as group_id, cast(count(l_partkey) as integer) as n, coalesce(string_agg(l_partkey::varchar, ',' order by l_partkey), '') as products from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey",
    "product_type_lookup": "select coalesce(n_name, (c_nationkey + 5)::varchar) as image_type, cast(coalesce(n_regionkey = 1, false) as integer) as overlayable, count(*) as n from customer left join nation on c_nationkey + 5 = n_nationkey group by all",
    "label_tokens": f"with {LABELS} select path, cast(pos as integer) as pos, name, kind, s, i, d, n from item",
    "label_groups": f"with {LABELS} select path, name, section, title, number from item",
    "cache_anti_join": f"with {REQUESTS}, {TASKS} select distinct cache_hash from req where cache_hash not in (select cache_hash from task where finished)",
    "source_semi_join": "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_custkey % 4 > 0)",
    "latest_event_wins": "select user_id, ts, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "cache_state": f"""with {REQUESTS}, {TASKS}, r as (select distinct cache_hash from req), s as (select r.cache_hash, case when finished then 'complete' when error then 'errored' when started is null then 'missing' when 1700006000 - coalesce(progressed, started) > 3600 then 'zombie'
when modified is null or started < modified then 'stale' else 'running' end as state from r left join task t on r.cache_hash = t.cache_hash) select *, cast(state in ('complete', 'running') as integer) as is_cached from s""",
    "admission_window": f"with {REQUESTS}, u as (select o_orderkey, cast(sum(cost) over (partition by o_custkey order by requested, o_orderkey rows unbounded preceding) as bigint) as used from req) select o_orderkey, used, cast(used <= 300000 as integer) as admitted from u",
    "retry_gate": "with r as (select event_id, cast(row_number() over (partition by user_id, event_type order by ts, event_id) as integer) as receive_count from events) select event_id, receive_count, case when receive_count >= 3 then 'fail_queue' else 'process' end as route from r",
    "progress_summary": """with t as (select c_nationkey as worker, c_custkey % 5 as hs, c_custkey % 2 * 4 as he, c_custkey % 3 as es, c_custkey % 4 as ee, greatest(0, c_custkey % 80 - 10) as na, c_custkey % 50 = 0 as done from customer),
b as (select *, case when he > 0 then 10e0 else 0e0 end as b1 from t), c as (select *, b1 + case when ee > 0 then 10e0 else 0e0 end as b2 from b),
p as (select worker, case when done then 100e0 when he > 0 and na = 0 and hs < he then 10e0 * hs / he when ee > 0 and na = 0 and es < ee then b1 + 10e0 * es / ee when na = 0 then b2 else b2 + (100 - b2) * least(1e0, na / 64e0) end as percent from c)
select worker, min(percent) as least, max(percent) as most, sum(percent) as total, count(*) as tasks from p group by 1""",
    "delete_batches": "with b as (select o_orderstatus, o_orderkey, substr(sha1(o_orderkey::varchar), 1, 1) as part from orders), n as (select *, cast((row_number() over (partition by o_orderstatus, part order by o_orderkey) - 1) // 100 as integer) as number from b) select o_orderstatus, part, number, count(*) as n, min(o_orderkey) as first from n group by all",
    "metadata_json": f"with {LEVELS} select image_id, max(w) as width, max(h) as height, max(level) as levels from levels group by image_id",
    "dzi_descriptor": f"""with {IMAGES} select image_id, '<?xml version="1.0" encoding="UTF-8"?><Image xmlns="http://schemas.microsoft.com/deepzoom/2008" TileSize="254" Overlap="1" Format="png"><Size Width="' || width || '" Height="' || height || '"/></Image>' as dzi from img""",
    "tile_requests": f"with {REQUESTS} select o_orderkey, cache_hash as hash, case when o_orderkey % 2 = 0 then 'data' end as proxy, (o_orderkey % 9)::varchar as level, (o_custkey % 7)::varchar as col, '3' as row, 'png' as ext from req",
    "label_decode": f"with {VECTORS} select image_id as path, band, cast(sum(dn) as bigint) as s, count(*) as n from color group by all",
    "png_tiles": f"with {BOUNDS} select c.image_id, band, cast(sum(case when dn <= lo then 0 when dn >= hi then 255 else greatest(0, least(255, cast(trunc((dn - lo) * 255 / (hi - lo)) as integer))) end) as bigint) as s from color c join bounds b on c.image_id = b.image_id group by all",
    "stream_ingest": """with n as (select user_id::varchar as key, ts, case when event_type = 'purchase' then 'ObjectRemoved:Delete' when event_type in ('click', 'view') then 'ObjectCreated:Put' else 'Other' end as name from events),
l as (select key, name from n qualify row_number() over (partition by key order by name <> 'Other' desc, ts desc, name desc) = 1) select key, case when name like 'ObjectCreated%' then 'build' when name like 'ObjectRemoved%' then 'delete' else 'ignore' end as action from l""",
    "stream_table": """select user_id::varchar as key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as at, case event_type when 'purchase' then 'delete' else 'build' end as action from events where event_type in ('purchase', 'click', 'view')
qualify row_number() over (partition by user_id order by ts desc, event_type = 'purchase' desc) = 1""",
    "delivery_state": """with c as (select user_id::varchar as message, event_type as receiver, count(*) as times from events group by all)
select *, sum(times) over (partition by message)::bigint as total, case when sum(times) over (partition by message) >= 9 then 'fail_queue' else 'process' end as route from c""",
    "silent_tasks": """with l as (select user_id::varchar as task, count(*) as deliveries, max(ts) as newest from events group by 1)
select task, deliveries, case when newest + interval 12 hour < max(newest) over () - interval 1 minute then 'zombie' else 'running' end as status from l""",
}
