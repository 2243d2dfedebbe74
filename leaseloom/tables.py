"""The named bundle of core frames every operator reads.

Facts carry their natural keys (`unit_code`, `unit_type_code`) and the charge lines carry the
book and status of their lease, so book-grain marts never join two facts. Both facts are meant to
be stored partitioned by `snapshot_id`.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    snapshot: DataFrame | None = None        # snapshot_id, as_of_date, report_month
    property: DataFrame | None = None        # property_id, property_code, property_name, asset_key, book_type
    unit_type: DataFrame | None = None       # property_id, unit_type_code
    unit: DataFrame | None = None            # property_id, unit_code, unit_type_code, unit_sqft
    resident: DataFrame | None = None        # resident_id, display_name
    charge_code: DataFrame | None = None     # charge_code, category, description, is_concession, label_verified
    lease: DataFrame | None = None
    lease_charge: DataFrame | None = None
    summary_group: DataFrame | None = None
    charge_summary: DataFrame | None = None
    availability: DataFrame | None = None
    run: DataFrame | None = None
    file: DataFrame | None = None
    issue: DataFrame | None = None
    audit: DataFrame | None = None
    insight: DataFrame | None = None
    insight_run: DataFrame | None = None
    # stored aggregates of the two facts, by book (see `rollups`); what reads a book's figures takes them where they are there
    book_detail: DataFrame | None = None
    book_code_charges: DataFrame | None = None
    book_expirations: DataFrame | None = None
    book_dates: DataFrame | None = None
    book_repeats: DataFrame | None = None
    book_files: DataFrame | None = None
    # what leases and their lines meet on; a lease's id is its own in all snapshots, and the snapshot lets whole folders be passed over
    lease_key: tuple[str, ...] = ("snapshot_id", "lease_id")

    def with_frames(self, **frames: DataFrame) -> "Tables":
        """The bundle with these frames. Aggregates of facts that change are dropped, unless they come along."""
        stale = {"lease", "lease_charge"} & set(frames)
        return replace(self, **((dict.fromkeys(STORED) if stale else {}) | frames))


#: Stored aggregates, all of them keyed by snapshot and property.
STORED = ("book_detail", "book_code_charges", "book_expirations", "book_dates", "book_repeats", "book_files")
#: Frames that hold a snapshot each row, so that one snapshot is a filter on all of them.
BY_SNAPSHOT = ("lease", "lease_charge", "summary_group", "charge_summary", "availability", *STORED)
