"""J5: repair the links of a saved site."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from pagework.operators import linkfix
from pagework.sources.backups import BackupStore
from pagework.sources.scratch import Scratch


@dataclass
class Repair:
    """Result of a repair: all ``files``, the ``fixes``, the ``backups`` and the ``report``."""

    files: DataFrame
    fixes: DataFrame
    backups: DataFrame | None
    report: DataFrame


def repair_sites(
    files: DataFrame,
    scratch: Scratch,
    replacement_url: str | None = None,
    use_local_fallback: bool = False,
    local_fallback: str = "index.html",
    backup: bool = True,
    stored: DataFrame | None = None,
    resolve: str = "root",
    store: BackupStore | None = None,
) -> Repair:
    """Replace the broken links of ``files(site, path, html)``.

    ``stored(site, path)`` lists what exists in the site, images included; by default the files. With a
    ``store`` the backups are written there before anything else, as a new generation.
    """
    links = scratch.keep(linkfix.file_links(files), "links")
    present = files.select("site", "path") if stored is None else stored
    broken = linkfix.broken_links(links, present, resolve)
    fallback = local_fallback if use_local_fallback else None
    fixes = scratch.keep(linkfix.plan_fixes(broken, replacement_url, fallback), "fixes")
    backups = linkfix.backups_of(files, fixes) if backup or store is not None else None
    if store is not None:
        store.add(backups)
    return Repair(
        linkfix.fix_links(files, fixes),
        fixes,
        backups,
        linkfix.fix_report(files, fixes),
    )
