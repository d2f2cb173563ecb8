"""The command surface: scans, stored results, and one read-side function a command.

Nothing here deletes an asset: commands return what a person may review.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import groups as G
from lodestone.operators import sessions as N
from lodestone.operators import state
from lodestone.sources import assets as A
from lodestone.sources.tables import Deletions, cut, exists, read_json, replace_table, write_json
from lodestone.streaming.jobs import BATCH_ROWS, Coverage, Journal, ScanJob

#: Scan sizes that a person may choose, and the album size above which to confirm.
SCAN_SIZES = [100, 300, 1000, 5000]
CONFIRM_ABOVE = 50
GROUPS = "group_id long, asset_id long, confidence double, keeper_id long"
ROLES = "library_id long, session long, session_type string, asset_id long, role string"


@dataclass(frozen=True)
class Settings:
    sensitivity: str = "balanced"
    include_screenshots: bool = True
    exclude_favorites: bool = True
    location_lookup: bool = False
    unprotected: tuple[str, ...] = ()


@dataclass
class Engine:
    """Assets, where results are kept, and the settings of the next scan."""

    spark: SparkSession
    assets: DataFrame
    store: str
    settings: Settings = field(default_factory=Settings)
    albums: DataFrame | None = None
    places: DataFrame | None = None
    #: Gives the analysis of rows that have none; here that is what came with them.
    analyzer: Callable[[DataFrame], DataFrame] = state.valid
    batch_rows: int = BATCH_ROWS
    #: Of the last scan that this engine finished.
    coverage: Coverage | None = None

    # scans

    def request(self, scope: A.Scope, sensitivity: str | None = None, content: str | None = None, place: str | None = None, kind: str = "duplicates") -> A.Request:
        s = self.settings
        options = A.Options(s.include_screenshots, s.exclude_favorites, content, place, s.location_lookup)
        return A.Request(scope, options, sensitivity or s.sensitivity, kind)

    def targets(self, request: A.Request) -> DataFrame:
        return A.scan(self.assets, request, self.albums, self.places)

    def start_photo_scan(self, request: A.Request) -> str:
        """Scan, group, rank and replace the stored groups (or sessions, by the request's kind)."""
        job = self.begin(request)
        self._finish(job, request.signature, request.kind, request.sensitivity)
        return f"Starting a {request.sensitivity} scan. I'll open the results for you to review — nothing is deleted automatically."

    def begin(self, request: A.Request, batches: int | None = 0) -> ScanJob:
        """Fix a scan's targets and its checkpoint, and analyse so many batches (None: all)."""
        job = ScanJob.begin(self.targets(request), self.store, [F.desc_nulls_last("capture_ts"), F.col("asset_id")], self.batch_rows)
        self.journal.put(request.signature, request.kind, request.sensitivity, job.name, False)
        if batches != 0:
            job.analyze(self.analyzer, batches)
        return job

    def continue_last_scan(self) -> str:
        """Go on with the scan that was begun last and never ended: batches that it committed stay as they are."""
        last = self.incomplete().first()
        if last is None:
            return self.get_duplicate_groups()
        self._finish(self.job(last), last.signature, last.kind, last.sensitivity)
        return f"Continuing your last {last.sensitivity} scan. I'll open the results for you to review — nothing is deleted automatically."

    def job(self, checkpoint) -> ScanJob:
        """The job that a checkpoint names."""
        return ScanJob(self.spark, self.store, self.assets.schema, checkpoint.job)

    def _finish(self, job: ScanJob, signature: str, kind: str, sensitivity: str) -> None:
        job.analyze(self.analyzer)
        rows, self.coverage = job.result(cut)
        if kind == "sessions":
            timed = cut(N.sessionize(rows))
            replace_table(N.analyze(timed, cut(N.sessions(timed))).select(*[F.col(c).cast(t) for c, t in (x.split() for x in ROLES.split(", "))]), f"{self.store}/sessions")
        else:
            rows = G.with_block(rows)
            members = cut(G.group_members(rows, sensitivity))
            ranked = G.rank_groups(members, rows, off=self.settings.unprotected)
            best = G.keepers(G.placeholder_keeper(members, rows), ranked)
            found = members.join(G.group_confidence(members, rows).select("group_id", "confidence"), "group_id").join(best, "group_id")
            replace_table(found.select("group_id", "asset_id", "confidence", "keeper_id"), f"{self.store}/groups")
        self.journal.put(signature, kind, sensitivity, job.name, True)

    @property
    def journal(self) -> Journal:
        return Journal(self.spark, self.store)

    def incomplete(self) -> DataFrame:
        """The scan that was begun last and never ended, with its kind."""
        return self.journal.incomplete()

    def skipped(self, request: A.Request) -> int:
        """How many targets have no valid analysis; after a scan ``coverage`` has it without another one."""
        rows = self.targets(request)
        return state.coverage(rows.select("asset_id"), rows.select("asset_id", "analysis_version")).first()["n_skipped"]

    def save_settings(self, **changes) -> None:
        """Change settings and keep them in the store, for this engine and those after it."""
        self.settings = replace(self.settings, **changes)
        write_json(self.spark, f"{self.store}/settings.json", asdict(self.settings))

    def load_settings(self) -> Settings:
        """The stored settings; what isn't stored has its default, and unknown names are left out."""
        path = f"{self.store}/settings.json"
        found = read_json(self.spark, path) if exists(self.spark, path) else {}
        known = {f.name: found[f.name] for f in fields(Settings) if f.name in found}
        self.settings = Settings(**known | ({"unprotected": tuple(known["unprotected"])} if "unprotected" in known else {}))
        return self.settings

    def find_duplicate_photos(self) -> str:
        return self.start_photo_scan(self.request(A.Recent(300), "conservative"))

    def find_similar_photos(self, mode: str) -> str:
        return self.start_photo_scan(self.request(A.Recent(300), T.MODE_SENSITIVITY[mode]))

    def find_best_shots(self) -> str:
        return self.start_photo_scan(self.request(A.Recent(300), "balanced"))

    def find_best_drone_shots(self) -> str:
        return self.start_photo_scan(self.request(A.Recent(500), "balanced", kind="sessions"))

    def update_dedupe_mode(self, mode: str) -> str:
        self.save_settings(sensitivity=T.MODE_SENSITIVITY[mode])
        return f"Okay, I'll use {T.SPOKEN_MODE[mode]} matching for your next scan."

    # stored results

    @property
    def group_table(self) -> Deletions:
        return Deletions(self.spark, f"{self.store}/groups", GROUPS, ["group_id"])

    @property
    def session_table(self) -> Deletions:
        return Deletions(self.spark, f"{self.store}/sessions", ROLES, ["library_id", "session"])

    def groups(self) -> DataFrame:
        return self.group_table.read()

    def session_roles(self) -> DataFrame:
        return self.session_table.read()

    def ranked(self, confidence: bool = True, groups: DataFrame | None = None) -> DataFrame:
        own = self.groups() if groups is None else groups
        sure = own.select("group_id", "confidence").distinct() if confidence else None
        return G.rank_groups(own.select("group_id", "asset_id"), self.assets, sure, self.settings.unprotected)

    def _top(self) -> DataFrame:
        top = self.groups().select("group_id", "confidence").distinct().orderBy(F.desc("confidence"), "group_id").limit(1)
        return self.groups().join(top.select("group_id"), "group_id", "left_semi")

    # commands that read

    def get_duplicate_groups(self) -> str:
        n, more = G.snapshot(self.groups()).first()
        if not n:
            return "I haven't found any duplicate groups yet. Try running a scan first."
        return f"Your last scan found {n} {_s('group', n)} with about {more} {_s('photo', more)} to review."

    def get_group_details(self, group_id: int) -> str:
        own = self.groups().where(F.col("group_id") == group_id)
        r = self.ranked(groups=own)
        d = G.decisions(r).join(r.where("is_keeper").select("group_id", "badges", "confidence", "n"), "group_id")
        row = d.select(T.group_details(F.col("confidence"), F.col("n"), F.col("badges"), F.col("n_removals"), F.col("n_protected")).alias("said")).first()
        return row["said"] if row else "I couldn't find that group. It may have already been reviewed."

    def cleanup_plan(self) -> DataFrame:
        return G.cleanup_plan(self.ranked())

    def generate_cleanup_plan(self) -> str:
        p = self.cleanup_plan().first()
        if not p.n_removals and not p.n_protected:
            return "There's nothing to clean up yet. Try running a scan first."
        return f"I recommend reviewing {p.n_removals} {_s('photo', p.n_removals)} for removal. I protected {p.n_protected} {_s('photo', p.n_protected)}. Nothing is deleted until you review and confirm."

    def explain_recommendation(self) -> str:
        """Of the surest group's stored keeper."""
        top = self._top()
        r = self.ranked(confidence=False, groups=top).join(top.select("asset_id", "keeper_id"), "asset_id").where("asset_id = keeper_id")
        row = r.select(T.keeper_summary(F.col("badges")).alias("said")).first()
        return row["said"] if row else "I don't have a recommendation to explain yet. Try running a scan first."

    def show_cleanup_summary(self) -> str:
        s = G.snapshot(self.groups())
        return s.select(T.last_scan_summary(F.col("group_count"), F.col("reviewable")).alias("said")).first()["said"]

    def show_session_summary(self) -> str:
        s = N.session_stats(self.session_roles())
        return s.select(T.session_summary(*[F.col(c) for c in ("clusters", "best", "protected", "redundant")]).alias("said")).first()["said"]

    def best_shots(self) -> DataFrame:
        return self.groups().where("keeper_id is not null").select("keeper_id").distinct()

    def create_album(self, title: str, confirmed: bool = False) -> str:
        shots = self.best_shots()
        n = shots.count()
        if not n:
            return "I don't have any best shots to save yet. Try running a scan first."
        if n > CONFIRM_ABOVE and not confirmed:
            return f"This adds {n} photos. Please confirm."
        state.append_album(shots, title, f"{self.store}/albums")
        return f'I created the album "{title}" with {n} {_s("photo", n)}.'

    def review_done(self, group_id: int) -> None:
        """Take a reviewed group out of the stored ones: one row in a log, also if others review meanwhile."""
        self.group_table.delete(self.spark.createDataFrame([(group_id,)], "group_id long"))

    def session_review_done(self, library_id: int, session: int) -> None:
        """Take a reviewed session out of the stored ones."""
        self.session_table.delete(self.spark.createDataFrame([(library_id, session)], "library_id long, session long"))


def _s(word: str, n: int) -> str:
    return word if n == 1 else word + "s"
