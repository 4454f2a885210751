"""Names and fixed values of the domain."""
from typing import NamedTuple

#: Stages and kinds of peaks.
PEAK_TYPES = ("scanned", "broad", "noise", "overlap", "unassigned", "ladder", "called", "stutter", "artifact", "bin", "ignored")
#: Dyes, and other names under which instruments store them.
DYES = ("6-FAM", "NED", "VIC", "PET", "LIZ")
DYE_NAMES = {"6FAM": "6-FAM", "PAT": "PET", "Bn Joda": "LIZ"}
#: Emission wavelengths in nm that hold where a file does not state them.
WAVELENGTHS = {"6-FAM": 522, "NED": 575, "VIC": 554, "PET": 595, "LIZ": 655}
#: Colours of labelled sets, in turn.
PALETTE = ("#1f78b4", "#33a02c", "#e31a1c", "#ff7f00", "#6a3d9a", "#b15928", "#a6cee3", "#b2df8a", "#fb9a99", "#fdbf6f", "#cab2d6", "#ffff99")


class Limits(NamedTuple):
    max_rss: float
    min_score: float
    min_sizes: int


class Ladder(NamedTuple):
    name: str
    dye: str
    sizes: tuple[float, ...]
    strict: Limits
    relax: Limits
    clusters: int
    anchors: int
    signature: tuple[float, ...]
    order: int


#: Fragment sizes of the size standards, and limits of a good alignment.
LADDERS = {
    "LIZ600": Ladder(
        "LIZ600", "LIZ",
        (20.0, 40.0, 60.0, 80.0, 100.0, 114.0, 120.0, 140.0, 160.0, 180.0, 200.0, 214.0, 220.0, 240.0, 250.0, 260.0, 280.0, 300.0, 314.0, 320.0, 340.0, 360.0, 380.0, 400.0, 414.0, 420.0, 440.0, 460.0, 480.0, 500.0, 514.0, 520.0, 540.0, 560.0, 580.0, 600.0),
        Limits(40.0, 34.0, 36), Limits(56.25, 33.0, 36), 6, 2, (140.0, 160.0, 180.0, 200.0, 214.0, 220.0, 240.0, 250.0, 260.0, 280.0, 300.0, 314.0, 320.0), 3,
    ),
    "LIZ500": Ladder(
        "LIZ500", "LIZ",
        (35.0, 50.0, 75.0, 100.0, 139.0, 150.0, 160.0, 200.0, 250.0, 300.0, 340.0, 350.0, 400.0, 450.0, 490.0, 500.0),
        Limits(17.5, 14.0, 16), Limits(25.0, 13.0, 16), 4, 1, (75.0, 100.0, 139.0, 150.0, 160.0, 200.0, 250.0), 2,
    ),
}
