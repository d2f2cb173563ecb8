"""DuckDB SQL with the results of the catalog's queries."""

from __future__ import annotations

from lodestone.functions import text as T
from lodestone.functions.similarity import REASONS, SENSITIVITIES

ASSETS = """
assets as (
select asset_id, scene, variant, library_id, capture_ts, lat, lon, width, height,
 width*height - variant*1000 pixel_count, is_screenshot, hash,
 ((asset_id*37)%101)/100.0::double sharpness, ((asset_id*53)%101)/100.0::double exposure, ((asset_id*71)%101)/100.0::double contrast,
 1.0::double - ((asset_id*37)%101)/100.0::double motion_blur,
 asset_id%17=0 is_favorite, asset_id%23=0 is_edited, asset_id%13=0 is_live, asset_id%97=0 is_hidden, asset_id%89=0 is_shared,
 face_count, face_count > 0 has_people, case when scene%9=0 then concat('B',scene) end burst_id,
 case when scene%10<3 then [(scene%97)::double, (scene%89)::double, variant*0.3::double] end feature,
 case when face_count=0 or scene%7=0 then []::double[][] else list_transform(range(1,face_count+1), lambda f: [(scene*10+f)::double, case when variant=3 then 0.9::double else variant*0.1::double end]) end faceprints,
 case when scene%11<>0 then [(200-variant*40)::int, (variant*40)::int, (scene%50)::int, 10] end color_signature,
 case when scene%5<>0 then 100.0::double + variant*3 end altitude,
 case when scene%3=0 then 'golden dog' else 'mountain lake' end label1, 0.2::double+(asset_id%50)/100.0::double conf1, 'party' label2, (asset_id%20)/100.0::double conf2,
 case when asset_id%41=0 then 2 else 3 end analysis_version,
 concat(coalesce(strftime(capture_ts, '%Y-%j'), 'nodate'), '|', case when height > 0 then trunc(width/height::double*10)::int else 0 end, '|', case when is_screenshot then 's' else 'p' end) block
from (select *, cast(case when scene%6=0 then 1+scene%3 else 0 end as int) face_count from (select event_id asset_id, scene, variant, scene%16 library_id,
  case when scene%50=49 then null else scene_ts + to_seconds(cast((scene//250)*2592000 + variant*20 as int)) end capture_ts,
  case when scene%5=0 then null else 37.0::double + (scene%7)*0.01::double + variant*0.0002::double end lat,
  case when scene%5=0 then null else -122.0::double end lon,
  case scene%4 when 0 then 4000 when 1 then 3000 when 2 then 1920 else 1170 end width,
  case scene%4 when 0 then 3000 when 1 then 4000 when 2 then 1080 else 2532 end height,
  scene%4=3 is_screenshot,
  xor(((scene*48271+11)*69621)%2147483647*4294967296 + ((scene*16807+7)*39373)%2147483647*2,
      (case variant when 0 then 0 when 1 then 7 when 2 then 1048575 else 1073741823 end)::bigint) hash
 from (select event_id, event_id//4 scene, event_id%4 variant, min(ts) over (partition by event_id//4) scene_ts from events)))
)"""


def _l2(a: str, b: str) -> str:
    return f"case when len({a}) = len({b}) then sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]-z[2])*(z[1]-z[2])))) end"


def _meters(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    s = f"(sin(radians({lat2}-{lat1})/2)*sin(radians({lat2}-{lat1})/2) + cos(radians({lat1}))*cos(radians({lat2}))*sin(radians({lon2}-{lon1})/2)*sin(radians({lon2}-{lon1})/2))"
    return f"(6371000.0::double*2*atan2(sqrt({s}), sqrt(1-{s})))"


HAMMING = "bit_count(xor(a.hash, b.hash))::int"
DISTANCE = f"coalesce({_l2('a.feature', 'b.feature')}, {HAMMING}/64.0::double)"
_A, _B = "case when len(a.faceprints) <= len(b.faceprints) then a.faceprints else b.faceprints end", "case when len(a.faceprints) <= len(b.faceprints) then b.faceprints else a.faceprints end"
NEAREST = f"list_transform({_A}, lambda f: list_min(list_transform({_B}, lambda g: sqrt((f[1]-g[1])*(f[1]-g[1])+(f[2]-g[2])*(f[2]-g[2])))))"
PEOPLE = f"(case when a.face_count <> b.face_count then false when a.face_count = 0 then true when len(a.faceprints) = 0 or len(b.faceprints) = 0 then false else list_max({NEAREST}) <= 0.55::double end)"
COLOR = "(list_sum(list_transform(list_zip(a.color_signature, b.color_signature), lambda z: least(z[1], z[2])))::double / least(list_sum(a.color_signature), list_sum(b.color_signature))::double)"
SESSION = f"(coalesce(abs(epoch_us(a.capture_ts) - epoch_us(b.capture_ts)) <= 600000000, false) and coalesce({_meters('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 60, true))"
NEAR = f"{HAMMING} <= 22"
IN_BLOCK = "assets a join assets b on a.block = b.block and a.asset_id < b.asset_id"
IN_SCENE = "assets a join assets b on a.scene = b.scene and a.asset_id < b.asset_id"


def _accept(s: str) -> str:
    t = SENSITIVITIES[s]
    strict = f"({NEAR} and {DISTANCE} <= {t.strict}::double)"
    relaxed = f"({SESSION} and {DISTANCE} <= {t.relaxed}::double and coalesce({COLOR} >= 0.6::double, true))"
    return f"{PEOPLE} and ({strict}{f' or {relaxed}' if t.groups_poses else ''})"


def _pairs(s: str, name: str = "edges", block: str = "block") -> str:
    return f"{name} as (select a.asset_id src, b.asset_id dst, {DISTANCE} distance from rows a join rows b on a.{block} = b.{block} and a.asset_id < b.asset_id where {_accept(s)})"


def _components(edges: str = "edges") -> str:
    """Labels spread to the smallest node: each node keeps the set of smaller labels it has seen."""
    return f"""both_ways as (select src u, dst v from {edges} union all select dst, src from {edges}),
reach(node, label) as (select u, u from both_ways union select b.v, r.label from reach r join both_ways b on b.u = r.node where r.label < b.v),
members as (select min(label) group_id, node asset_id from reach group by node)"""


def _with(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"


ROWS = "rows as (select * from assets)"
SCANNED = "rows as (select * from assets where not is_hidden and not is_favorite and analysis_version >= 3)"
GROUPS = [ASSETS, ROWS, _pairs("balanced"), _components()]
CONFIDENCE = f"""confidence as (select m.group_id, count(distinct m.asset_id) n, least(0.99::double, greatest(0.5::double, 1 - avg({DISTANCE}))) confidence
from members m join members o on m.group_id = o.group_id and m.asset_id < o.asset_id join assets a on a.asset_id = m.asset_id join assets b on b.asset_id = o.asset_id group by m.group_id),
sizes as (select group_id, count(*) n from members group by group_id),
sure as (select group_id, sizes.n, confidence from sizes join confidence using (group_id))"""


def _score(most: str) -> str:
    return f"0.30::double*sharpness + 0.20::double*exposure + 0.15::double*(pixel_count::double/{most}) + 0.10::double*(case when has_people then least(1.0::double, 0.5::double + face_count*0.1::double) else 0 end) + 0.10::double*(case when is_favorite or is_edited then 1 else 0 end) + 0.10::double*contrast + 0.05::double"


def _reasons(off: tuple[str, ...] = ()) -> str:
    return "list_filter([" + ", ".join(f"case when {flag} then '{name}' end" for name, flag in REASONS.items() if name not in off) + "], lambda x: x is not null)"


def _ranked(confidence: bool = True, name: str = "ranked") -> str:
    join, sure = ("join sure using (group_id)", "confidence") if confidence else ("", "0")
    badges = "list_filter([case when sharp = 1 then 'Sharpest' end, case when exposed = 1 then 'Best exposure' end, case when pixel_count = most then 'Highest resolution' else 'Lower resolution' end, case when is_edited then 'Edited' end, case when is_favorite then 'Favorite' end, case when is_live then 'Live Photo' end, case when has_people then 'Has people' end, case when motion_blur > 0.6::double or sharpness < 0.3::double then 'Blurry' end, case when is_protected then 'Protected' end], lambda x: x is not null)"
    return f"""scored as (select m.group_id, assets.*, {sure} sureness, max(pixel_count) over g most, count(*) over g members,
  row_number() over (partition by m.group_id order by sharpness desc, asset_id) sharp, row_number() over (partition by m.group_id order by exposure desc, asset_id) exposed
  from members m join assets using (asset_id) {join} window g as (partition by m.group_id)),
judged as (select *, {_score("most")} score, {_reasons()} reasons from scored),
placed as (select *, row_number() over (partition by group_id order by floor(score*100+0.5::double)/100 desc, is_edited desc, pixel_count desc, is_favorite desc, is_live desc, has_people desc, asset_id) rank,
  len(reasons) > 0 and not ((members <= 2 or sureness >= 0.95::double) and array_to_string(reasons, ',') = 'hasPeople') is_protected from judged),
{name} as (select *, rank = 1 is_keeper, rank > 1 and not is_protected is_removal, {badges} badges from placed)"""


RANKED = [*GROUPS, CONFIDENCE, _ranked()]
DECISIONS = "decisions as (select group_id, max(case when is_keeper then asset_id end) keeper_id, count_if(is_removal)::bigint n_removals, count_if(is_protected)::bigint n_protected from ranked group by group_id)"
SESSIONS = f"""steps as (select *, lag(capture_ts) over w p_ts, lag(lat) over w p_lat, lag(lon) over w p_lon from assets where capture_ts is not null window w as (partition by library_id order by capture_ts, asset_id)),
marks as (select *, case when p_ts is null or epoch_us(capture_ts) - epoch_us(p_ts) > 1800000000 or coalesce({_meters("p_lat", "p_lon", "lat", "lon")} > 150, false) then 1 else 0 end is_new from steps),
numbered as (select *, sum(is_new) over (partition by library_id order by capture_ts, asset_id rows unbounded preceding)::bigint session from marks)"""


def _bucket(n: int) -> str:
    return f"case when lat is not null and lon is not null then printf('%.{n}f,%.{n}f', round(lat, {n}), round(lon, {n})) end"


LISTED = f"""listed as (select library_id, session, count(*) n, min(capture_ts) start_ts, max(capture_ts) end_ts, (epoch_us(max(capture_ts)) - epoch_us(min(capture_ts)))/1e6 span,
  arg_min({_bucket(4)}, row(capture_ts, asset_id)) filter (lat is not null and lon is not null) bucket, count(distinct burst_id) bursts, count(burst_id) in_burst, bool_or(lat is not null and lon is not null) located from numbered group by all),
typed as (select *, case when n >= 2 and ((bursts = 1 and in_burst = n) or span <= 30) then 'burst' when n >= 2 and located and span <= 1200 then 'droneLike' when span <= 1800 then 'photoSession' else 'event' end session_type from listed)"""
UNIQUE = f"(coalesce(abs(c.altitude - k.altitude) >= 8, false) or coalesce({_meters('c.lat', 'c.lon', 'k.lat', 'k.lon')} >= 30, false) or abs(c.width/c.height::double - k.width/k.height::double) >= 0.3::double)"
ROLES = [
    ASSETS,
    SESSIONS,
    LISTED,
    "rows as (select * replace (concat_ws('|', library_id, session, block) as block) from numbered)",
    _pairs("balanced"),
    _components(),
    _ranked(confidence=False),
    f"""known as (select numbered.* replace (case when session_type = 'droneLike' then numbered.altitude end as altitude), session_type, ranked.group_id, ranked.is_keeper, ranked.reasons from numbered join typed using (library_id, session) left join ranked using (asset_id)),
roles as (select c.library_id, c.session, c.session_type, c.asset_id, case when c.group_id is null then 'protected' when c.is_keeper then 'best' when len(c.reasons) > 0 or {UNIQUE} then 'protected' else 'redundant' end as role
  from known c left join (select * from known where is_keeper) k on c.group_id = k.group_id)""",
]


def _plural(word: str, n: str) -> str:
    return f"case when {n} = 1 then '{word}' else '{word}s' end"


def _counted(n: str, word: str) -> str:
    return f"concat({n}, ' ', {_plural(word, n)})"


def _joined(parts: str) -> str:
    return f"case when len({parts}) <= 2 then array_to_string({parts}, ' and ') else concat(array_to_string({parts}[:-2], ', '), ', and ', {parts}[-1]) end"


def _keeper_text(badges: str = "badges") -> str:
    parts = "list_filter([" + ", ".join(f"case when list_contains({badges}, '{b}') then '{p}' end" for b, p in T.PREDICATES.items()) + "], lambda x: x is not null)"
    return f"case when len({parts}) = 0 then 'Recommended as the best of this group.' else concat('Recommended because it ', {_joined(parts)}, '.') end"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _first(text: str, table: dict[str, list[str]]) -> str:
    return "case " + " ".join(f"when {' or '.join(f'''contains({text}, '{w}')''' for w in words)} then '{k}'" for k, words in table.items()) + " end"


def _look_up(key: str, table: dict[str, str]) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


def _range(phrase: str, now: str) -> tuple[str, str]:
    start = f"case {phrase} when 'today' then date_trunc('day', {now}) when 'yesterday' then date_trunc('day', {now}) - interval 1 day when 'lastWeekend' then date_trunc('week', {now}) - interval 2 day when 'lastWeek' then date_trunc('week', {now}) - interval 7 day when 'lastMonth' then date_trunc('month', {now}) - interval 1 month when 'lastYear' then date_trunc('year', {now}) - interval 1 year end"
    end = f"case {phrase} when 'today' then {now} when 'yesterday' then date_trunc('day', {now}) when 'lastWeekend' then date_trunc('week', {now}) when 'lastWeek' then date_trunc('week', {now}) when 'lastMonth' then date_trunc('month', {now}) when 'lastYear' then date_trunc('year', {now}) end"
    return start, end


def _pick(words: list[str], by: int) -> str:
    return f"{_list(words)}[((asset_id//{by}) % {len(words)})::int + 1]"


REQUESTS = f"""requests as (select asset_id, case when asset_id % 61 = 0 then '  ' else concat_ws(' ', {_pick(["Find", "hello", "please clean", "Scan my", "show"], 1)}, {_pick(["photos", "dogs", "photos of beach sunset", "duplicates at Mall of America", ""], 5)},
  {_pick(["", "last weekend", "from past month", "yesterday", "past weekend", "TODAY", "last year", "this week"], 25)}, {_pick(["", "carefully", "thorough", "balanced", "drone"], 200)}, {_pick(["", "no screenshots"], 2)}) end as text from assets)"""
_NOW = "timestamp '2026-06-17 15:30:00'"
_START, _END = _range("phrase", _NOW)
_LIMIT = "case when phrase is null then case when location_query is not null then 1000 else 300 end end"


def _capital(x: str) -> str:
    return "case " + x + " " + " ".join(f"when '{k}' then '{v.title()}'" for k, v in T.SPOKEN_MODE.items()) + " end"


def _summary(shots: str) -> str:
    noun = "coalesce(concat(content_query || ' photos'), 'photos')".replace("concat(content_query || ' photos')", "content_query || ' photos'")
    return f"""{_capital("mode")} || ' scan of ' || case when phrase is not null then {noun} || ' from ' || {_look_up("phrase", T.SPOKEN_PHRASE)} else 'your ' || ({_LIMIT}) || ' most recent ' || {noun} end || coalesce(' at ' || location_query, '') || ', ' || case when {shots} then 'including screenshots' else 'excluding screenshots' end || '.'"""


PARSED = f"""worded as (select asset_id, text, lower(trim(text)) low, list_filter(regexp_split_to_array(lower(trim(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') words from requests),
subjects as (select *, list_filter(words, lambda w: length(w) >= 2 and regexp_matches(w, '\\p{{L}}') and not list_contains({_list(T.SCAN_VERBS + T.OBJECT_NOUNS + T.FILLER)}, w)) own, list_has_any(words, {_list(T.SCAN_VERBS + T.OBJECT_NOUNS)}) framed from worded),
parsed as (select asset_id, text, low, {_first("low", T.MODES)} named_mode, coalesce({_first("low", T.MODES)}, 'balanced') as mode, {_first("low", T.DATE_PHRASES)} phrase, not ({" or ".join(f"contains(low, '{w}')" for w in T.NO_SCREENSHOTS)}) include_screenshots,
  case when framed and len(own) > 0 and list_has_all({_list(T.VISUAL_SUBJECTS)}, own) then array_to_string(own, ' ') end content_query, case when framed and len(own) > 0 and not list_has_all({_list(T.VISUAL_SUBJECTS)}, own) then array_to_string(own, ' ') end location_query from subjects)"""

FEATURES = """features as (select asset_id, analysis_version, sharpness from assets where asset_id % 4 <> 0),
targets as (select asset_id, -asset_id ord from assets where asset_id % 3 <> 1), valid as (select * from features where analysis_version >= 3)"""
_VISIBLE = "not is_hidden"
_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
ALBUMS = "members as (select scene % 10 album_id, concat(case when scene % 20 < 10 then 'Trip ' else 'trip ' end, scene % 10) title, scene % 10 = 9 shared, asset_id from assets), albums as (select album_id, min(title) title, count(*) n_images from members where not shared group by album_id)"
#: Pictures depend on the scene modulo 256 and the variant only: each different one is worked out once.
GRAY = "gray as (select s, variant, list_transform(range(0, {n}), lambda i: ((s*31 + i*i*(variant+3) + i*17) % 256)::int) px from (select distinct scene % 256 s, variant from assets))"
SHOWN = "assets join {0} on {0}.s = assets.scene % 256 and {0}.variant = assets.variant"


def _s(column: str) -> str:
    return f"{_STAMP.format(column)} as {column}"


ORACLES: dict[str, str] = {
    "scan_recent": _with(ASSETS) + f"select asset_id, {_s('capture_ts')} from assets where {_VISIBLE} and not is_favorite order by assets.capture_ts desc nulls last, asset_id limit 300",
    "scan_date_range": _with(ASSETS) + f"select asset_id, {_s('capture_ts')} from assets, (select min(capture_ts) low from assets) where {_VISIBLE} and not is_screenshot and assets.capture_ts between low and date_trunc('second', low) + interval 40 day",
    "scan_album": _with(ASSETS) + f"select asset_id from assets where {_VISIBLE} and not is_favorite and scene % 10 = 3",
    "album_listing": _with(ASSETS, ALBUMS) + "select * from albums",
    "album_search": _with(ASSETS, ALBUMS) + "select album_id, title from albums where contains(lower(title), 'trip 1') union all select album_id, title from albums where album_id in (2, 99)",
    "content_filter": _with(ASSETS) + f"select asset_id from assets where {_VISIBLE} and (" + " or ".join(f"(conf{i} >= 0.1::double and (contains(label{i}, '{w}') or contains('{w}', label{i})))" for i in (1, 2) for w in ("dogs", "puppies", "gold")) + ")",
    "location_filter": _with(ASSETS) + f"select asset_id from assets where {_VISIBLE} and lat is not null and floor((round(lat, 3) - 37)*100 + 0.05::double)::int % 2 = 0",
    "blocking_key": _with(ASSETS) + "select asset_id, block from assets",
    "location_bucket": _with(ASSETS) + f"select asset_id, {_bucket(4)} bucket, {_bucket(2)} coarse, case when asset_id % 2 = 1 then -altitude else altitude end meters_above from assets",
    "protection_reasons": _with(ASSETS) + f"select asset_id, array_to_string({_reasons()}, ',') reasons, array_to_string({_reasons(('livePhoto',))}, ',') without_live from assets",
    "quality_score": _with(ASSETS) + f"select asset_id, round({_score('12000000')}, 9) score from assets",
    "hamming_pairs": _with(ASSETS) + f"select a.block as block, count(*) n_pairs, sum({HAMMING})::bigint bits from {IN_BLOCK} where {NEAR} group by 1",
    "pair_predicates": _with(ASSETS) + f"select a.block as block, count(*) n_pairs, count_if({NEAR})::bigint n_near, count_if({SESSION})::bigint n_session, count_if({PEOPLE})::bigint n_people, count_if(coalesce({COLOR} >= 0.6::double, true))::bigint n_color from {IN_BLOCK} group by 1",
    "pair_distance": _with(ASSETS) + f"select a.asset_id a_asset_id, b.asset_id b_asset_id, round({DISTANCE}, 9) distance from {IN_SCENE}",
    "color_similarity": _with(ASSETS) + f"select a.asset_id a_asset_id, b.asset_id b_asset_id, round({COLOR}, 9) similarity from {IN_SCENE}",
    "face_set_match": _with(ASSETS) + f"select a.asset_id a_asset_id, b.asset_id b_asset_id, {PEOPLE} same, case when len(a.faceprints) > 0 and len(b.faceprints) > 0 then round(list_max({NEAREST}), 9) end worst from {IN_SCENE}",
    "great_circle": _with(ASSETS) + f"select a.asset_id a_asset_id, b.asset_id b_asset_id, round({_meters('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 4) meters from {IN_SCENE}",
    "group_confidence": _with(*GROUPS, CONFIDENCE) + "select group_id, n, round(confidence, 6) confidence from sure",
    "groups_by_confidence": _with(*GROUPS, CONFIDENCE) + "select group_id, floor(confidence*100+0.5::double)::int spoken, floor(round(confidence, 9)*100)::int shown from sure",
    "placeholder_keeper": _with(*GROUPS) + "select group_id, arg_max(asset_id, row(pixel_count, -asset_id)) keeper_id from members join assets using (asset_id) group by group_id",
    "best_shot_rank": _with(*RANKED) + "select group_id, asset_id, round(score, 9) score, rank::int as rank, is_keeper, is_protected, is_removal from ranked",
    "badges": _with(*RANKED) + f"""select asset_id, array_to_string(badges, ',') badges, case when len(reasons) > 0 then concat('Protected because ', {_joined("list_transform(reasons, lambda r: " + _look_up("r", T.EXPLANATIONS) + ")")}, '.') end protection,
  concat('Suggested removal because it is visually similar', case when list_contains(badges, 'Blurry') then ' and has more motion blur' when list_contains(badges, 'Lower resolution') then ' and is lower resolution' else '' end, '.') removal from ranked""",
    "keeper_override": _with(*RANKED) + "select group_id, coalesce(max(case when is_keeper and group_id % 3 <> 0 then asset_id end), arg_max(asset_id, row(pixel_count, -asset_id))) keeper_id from ranked group by group_id",
    "best_shots": _with(*RANKED) + "select asset_id keeper_id from ranked where is_keeper",
    "cleanup_plan": _with(*RANKED, DECISIONS) + "select count(*) n_groups, sum(n_removals)::bigint n_removals, count_if(n_removals = 0 and n_protected > 0)::bigint n_warnings, (select count(distinct asset_id) from ranked where is_protected) n_protected, (select sum(pixel_count)::bigint from ranked where is_removal) savings from decisions",
    "cleanup_warnings": _with(*RANKED, DECISIONS) + "select *, case when keeper_id is null then 'noKeeper' when n_removals = 0 and n_protected > 0 then 'allProtected' end warning from decisions",
    "duplicate_snapshot": _with(*GROUPS) + f"select *, case when group_count = 0 then 'No duplicate groups yet. Try running a scan first.' else concat('Your last scan found ', {_counted('group_count', 'group')}, ' with about ', {_counted('reviewable', 'photo')}, ' you can review.') end summary from (select count(*) group_count, coalesce(sum(n - 1), 0)::bigint reviewable from (select count(*) n from members group by group_id))",
    "keeper_summary": _with(*RANKED) + f"select group_id, {_keeper_text()} summary from ranked where is_keeper",
    "group_details": _with(*RANKED, DECISIONS) + f"select d.group_id, concat('This is a ', floor(round(sureness, 9)*100+0.5::double)::int, '% match of ', members, ' photos. ', {_keeper_text()}, ' ', {_counted('n_removals', 'photo')}, ' suggested for removal, ', n_protected, ' protected and kept.') details from decisions d join ranked r on d.group_id = r.group_id and is_keeper",
    "top_group": _with(*GROUPS, CONFIDENCE, _ranked(confidence=False)) + f"select group_id, asset_id keeper_id, {_keeper_text()} summary from ranked where is_keeper and group_id = (select group_id from sure order by round(confidence, 9) desc, group_id limit 1)",
    "keeper_explanations": _with(*RANKED) + "select group_id, max(case when is_keeper then array_to_string(badges, ',') end) keeper_badges, concat_ws(',', case when bool_or(is_removal and list_contains(badges, 'Blurry')) then 'Blurry' end, case when bool_or(is_removal and list_contains(badges, 'Lower resolution')) then 'Lower resolution' end) removal_badges from ranked group by group_id",
    "manual_override": _with(*RANKED) + "select group_id, asset_id from ranked where is_removal <> (asset_id % 5 = 0)",
    "sessionize": _with(ASSETS, SESSIONS) + "select library_id, session, asset_id from numbered",
    "session_type": _with(ASSETS, SESSIONS, LISTED) + f"select library_id, session, n, {_s('start_ts')}, {_s('end_ts')}, round(span, 6) span, bucket, session_type from typed",
    "session_best_shots": _with(*ROLES) + "select library_id, session, asset_id, role from roles",
    "suggested_removals": _with(*ROLES) + "select asset_id from roles where role = 'redundant'",
    "session_summary_stats": _with(*ROLES) + f"select *, case when clusters = 0 then 'No photo sessions found yet. Try a drone or burst scan first.' else concat('Found ', clusters, ' sequence ', {_plural('group', 'clusters')}, '. Recommended ', best, ' best ', {_plural('shot', 'best')}, '. Protected ', protected, ' unique ', {_plural('angle', 'protected')}, '. Suggested removing ', redundant, ' redundant ', {_plural('photo', 'redundant')}, '.') end summary from (select count(distinct row(library_id, session)) clusters, count_if(role = 'best')::bigint best, count_if(role = 'protected')::bigint protected, count_if(role = 'redundant')::bigint redundant from roles)",
    "unique_angle": _with(ASSETS) + f"select c.asset_id, {UNIQUE} is_unique from assets c join assets k on c.scene = k.scene and k.variant = 0 and c.variant > 0",
    "pending_work": _with(ASSETS, FEATURES) + "select asset_id, ord from targets anti join valid using (asset_id)",
    "scan_coverage": _with(ASSETS, FEATURES) + "select count(*) n_targets, count(v.asset_id) n_covered, count(*) - count(v.asset_id) n_skipped from targets t left join valid v using (asset_id)",
    "feature_upsert": _with(ASSETS) + "select asset_id, case when asset_id % 3 = 0 and (asset_id % 2 <> 0 or asset_id % 5 <> 0) then exposure else sharpness end sharpness, case when asset_id % 3 = 0 and asset_id % 2 <> 0 and asset_id % 5 = 0 then 0 else 1 end computed_at from assets where asset_id % 2 = 0 or asset_id % 3 = 0",
    "batched_commits": _with(ASSETS) + "select asset_id, case when asset_id % 5 = 0 and (asset_id % 2 = 1 or not (asset_id % 2 = 0 or asset_id % 3 = 0)) then 3.0 when asset_id % 3 = 0 then 2.0 when asset_id % 2 = 0 then sharpness else 3.0 end::double sharpness, case when asset_id % 2 = 0 or asset_id % 3 = 0 then 1 else asset_id % 2 end::bigint computed_at from assets where asset_id % 2 = 0 or asset_id % 3 = 0 or asset_id % 5 = 0",
    "checkpoint_upsert": _with(ASSETS) + "select concat('recent:', library_id) signature, min(asset_id) + (library_id % 2 = 0)::int updated_at, library_id % 2 = 0 is_complete from assets group by library_id",
    "assets_by_id": _with(ASSETS) + "select asset_id, width, height, width/height::double aspect from assets where asset_id % 7 = 0",
    "cache_scan": _with(ASSETS, FEATURES) + "select asset_id, sharpness from valid where asset_id in (select asset_id from targets)",
    "browse": _with(ASSETS) + f"select asset_id, {_s('capture_ts')} from assets where {_VISIBLE} order by assets.capture_ts desc nulls last, asset_id limit 300",
    "deletable": _with(ASSETS) + "select asset_id from assets where asset_id % 3 = 0 and not is_shared",
    "stored_groups": _with(*GROUPS) + "select group_id, asset_id from members",
    "reviewed_groups": _with(*GROUPS) + "select group_id, asset_id from members where group_id % 3 <> 0",
    "group_by_id": _with(*GROUPS) + "select group_id, asset_id from members where group_id = (select max(group_id) from members)",
    "album_append": _with(*GROUPS) + "select 'Best' title, arg_max(asset_id, row(pixel_count, -asset_id)) asset_id from members join assets using (asset_id) group by group_id",
    "stored_sessions": _with(*ROLES) + f"select library_id, session, session_type, {_STAMP.format('start_ts')} start_ts, count_if(role = 'best')::bigint n_best, count_if(role = 'protected')::bigint n_protected, count_if(role = 'redundant')::bigint n_redundant from typed join roles using (library_id, session, session_type) group by library_id, session, session_type, typed.start_ts",
    "request_signatures": _with(ASSETS)
    + """select album_id, kind, concat_ws('|', kind, case when kind = 'duplicates' then concat('album:', album_id) else concat('date:', low, '-', high) end, case when album_id % 2 = 0 then 'True' else 'False' end, 'True', 'dogs', '', 'balanced') signature
from (select scene % 10 album_id, floor(epoch(min(capture_ts)))::bigint low, floor(epoch(max(capture_ts)))::bigint high from assets group by 1), (select unnest(['duplicates', 'sessions']) kind)""",
    "resumed_scan": _with(ASSETS, SCANNED, _pairs("balanced"), _components(), _ranked(confidence=False)) + "select m.group_id, m.asset_id, k.asset_id keeper_id from members m join ranked k on k.group_id = m.group_id and k.is_keeper",
    "exif_altitudes": _with(ASSETS) + "select asset_id, round(case when asset_id % 5 < 2 then 1 when asset_id % 5 = 2 then -1 end * (asset_id % 9000)::double / (asset_id % 7 + 1), 9) altitude from assets",
    "nearest_place": f"""with points as (select c_custkey, (c_custkey*37%181 - 90)::double lat, (c_custkey*73%361 - 180)::double lon from customer),
places as (select s_suppkey place_id, (s_suppkey*53%181 - 90)::double lat, (s_suppkey*97%361 - 180)::double lon from supplier),
found as (select c_custkey, min(row(round({_meters('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6), place_id)) best from points a, places b group by c_custkey)
select c_custkey, best[2] place_id, round(best[1], 3) meters from found""",
    "streamed_sessions": _with(ASSETS, SESSIONS) + "select library_id, session, asset_id from numbered",
    "growing_groups": _with(*GROUPS) + "select group_id, asset_id from members",
    "resumed_coverage": _with(ASSETS) + "select count(*) n_targets, count_if(analysis_version >= 3)::bigint n_covered, count_if(analysis_version < 3)::bigint n_skipped, 0::bigint n_incomplete from assets where not is_hidden and not is_favorite",
    "checkpoint_latest": _with(ASSETS) + "select concat('recent:', library_id) signature, max(asset_id) updated_at, library_id % 4 = 3 is_complete from assets group by library_id having library_id % 4 <> 3 order by max(asset_id) desc limit 1",
    "nl_parse": _with(ASSETS, REQUESTS, PARSED)
    + f"select asset_id, case when low <> '' then mode end as mode, case when low <> '' then phrase end phrase, {_STAMP.format(_START)} start_ts, {_STAMP.format(_END)} end_ts, case when low <> '' then {_LIMIT} end recent_limit, case when low <> '' then include_screenshots end include_screenshots, content_query, location_query, case when low <> '' then {_look_up('mode', T.MODE_SENSITIVITY)} end sensitivity, low <> '' and (phrase is not null or named_mode is not null or not include_screenshots or content_query is not null or location_query is not null) understood, case when low <> '' then {_summary('include_screenshots')} end summary from parsed",
    "date_phrases": _with(ASSETS) + "select asset_id, " + ", ".join(f"{_STAMP.format(x)} as {n}_{k}" for n in T.DATE_PHRASES for x, k in zip(_range(f"'{n}'", "capture_ts"), ("start", "end"), strict=True)) + " from assets",
    "draft_resolve": _with(
        ASSETS,
        REQUESTS,
        f"drafts as (select asset_id, lower(text) low, {_list(list(T.PHRASE_WORD))}[(asset_id % 6)::int + 1] p, asset_id % 7 <> 0 shots from requests), resolved as (select asset_id, case asset_id % 3 when 0 then 'aggressive' when 1 then 'conservative' else 'balanced' end as mode, case when contains(low, {_look_up('p', T.PHRASE_WORD)}) then p end phrase, case when asset_id % 2 = 0 and contains(low, 'dogs') then 'dogs' end content_query, case when asset_id % 5 = 0 then 'paris' end location_query, shots from drafts)",
    )
    + f"select asset_id, mode, phrase, content_query, location_query, {_LIMIT} recent_limit, {_summary('shots')} summary from resolved",
    "dhash": _with(ASSETS, GRAY.format(n=72)) + "select asset_id, list_reduce(list_transform(range(0, 64), lambda i: case when px[(i//8)*9 + i%8 + 1] > px[(i//8)*9 + i%8 + 2] then case when i = 63 then -9223372036854775808 else (1::bigint << i::int) end else 0::bigint end), lambda x, y: x | y)::bigint hash from " + SHOWN.format("gray"),
    "color_histogram": _with(ASSETS, GRAY.format(n=256), "bins as (select s, variant, list_transform(list_filter(px, lambda p: p % 9 <> 0), lambda p: (p//64)*16 + (((p*3)%256)//64)*4 + ((p*7)%256)//64) b from gray)")
    + "select asset_id, array_to_string(list_transform(range(0, 64), lambda i: least(255, (len(list_filter(b, lambda x: x = i)) * 255) // len(b))), ',') signature from " + SHOWN.format("bins"),
    "quality_metrics": _with(
        ASSETS,
        GRAY.format(n=4096),
        "flat as (select s*4 + variant g, unnest(range(0, 4096)) i, unnest(px) p from gray), lum as (select g, i, p, p/255.0::double l from flat)",
        "around as (select g, i, 4*l - lag(l) over w - lead(l) over w - lag(l, 64) over w - lead(l, 64) over w d from lum window w as (partition by g order by i))",
        "lap as (select g, avg(d*d) v from around where i // 64 between 1 and 62 and i % 64 between 1 and 62 group by g)",
        "whole as (select g, avg(l) m, stddev_pop(l) sd, avg(case when p < 4 or p > 251 then 1.0::double else 0 end) clipped from lum group by 1)",
    )
    + "select asset_id, round(least(1, greatest(0, v*25)), 9)::double sharpness, round(least(1, greatest(0, 1 - abs(m - 0.5::double)*2*0.6::double - clipped*0.8::double)), 9)::double exposure, round(least(1, greatest(0, sd*3.2::double)), 9)::double contrast, round(least(1, greatest(0, 1 - least(1, greatest(0, v*25)))), 9)::double motion_blur from assets join whole on whole.g = assets.scene % 256 * 4 + assets.variant join lap on lap.g = whole.g",
}
ORACLES["prompts"] = ORACLES["keeper_explanations"].replace("select group_id, max(case when is_keeper then array_to_string(badges, ',') end) keeper_badges", "select group_id, concat('A group of similar photos matches at ', floor(round(max(case when is_keeper then sureness end), 9)*100+0.5::double)::int, ' percent. Facts about the photo to keep: ', coalesce(nullif(array_to_string(max(case when is_keeper then badges end), ', '), ''), 'none'), '. Facts about the others: ', coalesce(nullif(replace(").replace(" removal_badges from ranked", ", ',', ', '), ''), 'none'), '. Say in one friendly sentence why that photo is kept. Use these facts only.') prompt from ranked").replace("sentences(", "(").replace(", concat_ws(',', case when bool_or", "concat_ws(',', case when bool_or")
_STATS = "(select count(distinct group_id) group_count, count_if(is_removal)::bigint reviewable, count(distinct case when is_protected and is_favorite then asset_id end) protected_favorites, count(distinct case when is_protected and is_live then asset_id end) protected_live, count(distinct case when is_protected and has_people then asset_id end) protected_people from ranked)"
_PARTS = f"list_filter([case when protected_favorites > 0 then {_counted('protected_favorites', 'favorite')} end, case when protected_live > 0 then concat(protected_live, ' Live ', {_plural('Photo', 'protected_live')}) end, case when protected_people > 0 then concat({_counted('protected_people', 'photo')}, ' with people') end], lambda x: x is not null)"
ORACLES["cleanup_stats"] = _with(*RANKED) + f"select *, case when group_count = 0 then 'No duplicate groups yet. Try running a scan first.' else concat('I found ', group_count, ' similar-photo ', {_plural('group', 'group_count')}, '. I recommend reviewing ', {_counted('reviewable', 'photo')}, ' for cleanup.', case when len({_PARTS}) > 0 then concat(' I protected ', {_joined(_PARTS)}, '.') else '' end) end summary from {_STATS}"
_AREAS = "boxes as (select asset_id, width, height, list_transform(range(1, 7), lambda i: {'i': i, 'w': (asset_id*i%7 + 1)/40.0::double, 'h': i/50.0::double}) b from assets), faces as (select asset_id, width, height, unnest(b) f from boxes), areas as (select *, row_number() over (partition by asset_id order by f.w*f.h desc, f.i) k from faces)"
ORACLES["largest_faces"] = _with(ASSETS, _AREAS) + """select asset_id, string_agg(f.i::varchar, ',' order by k) filter (k <= 4) as "order",
  max(case when k = 1 then round(least(width, (f.i/20.0::double)*width - f.w*width*0.2::double + f.w*width*1.4::double) - greatest(0, (f.i/20.0::double)*width - f.w*width*0.2::double), 6) end)::double crop_w,
  max(case when k = 1 then round(greatest(0, (1 - f.i/10.0::double - f.h)*height - f.h*height*0.2::double), 6) end)::double crop_y from areas group by asset_id"""
for _name in SENSITIVITIES:
    ORACLES[f"accepted_pairs_{_name}"] = _with(ASSETS, ROWS, _pairs(_name)) + "select src, dst, round(distance, 9) distance from edges"
    ORACLES[f"connected_components_{_name}"] = _with(ASSETS, ROWS, _pairs(_name), _components()) + "select group_id, asset_id from members"
