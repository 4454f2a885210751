"""Small text grammars: options, labels, colours of wavelengths."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def options_map(text: Column) -> Column:
    """'A=1,2;B' as a map: parts between ';' are key=value, a bare key means 'true', and the last of a key counts. Null text gives null, blanks are trimmed."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p != "")
    value = lambda p: F.when(p.contains("="), F.trim(F.regexp_replace(p, r"^[^=]*=", ""))).otherwise("true")
    pairs = F.transform(parts, lambda p: F.named_struct(F.lit("key"), F.trim(F.substring_index(p, "=", 1)), F.lit("value"), value(p)))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def plain_label(label: Column) -> Column:
    """A label that programs with simple readers accept: no blanks, and '_' for '|', '#' and '/'."""
    return F.translate(label, "|#/ ", "___")


def random_id(n: int) -> Column:
    """n letters and digits that differ from row to row and run to run."""
    parts = [F.replace(F.uuid(), F.lit("-"), F.lit("")) for _ in range(-(-n // 32))]
    return F.substring(F.concat(*parts), 1, n)


#: Corners of the colour ramps over the visible spectrum, in nm, with red, green and blue from 0 to 1.
SPECTRUM = ((380, (1.0, 0.0, 1.0)), (440, (0.0, 0.0, 1.0)), (490, (0.0, 1.0, 1.0)), (510, (0.0, 1.0, 0.0)), (580, (1.0, 1.0, 0.0)), (645, (1.0, 0.0, 0.0)), (781, (1.0, 0.0, 0.0)))
#: The eye's response falls to 0.3 at 380 nm and 780 nm, below 420 nm and from 701 nm on, by so many nm; display gamma.
FADE, GAMMA = ((380.0, 420.0), (701.0, 780.0), 80.0), 0.8


def wavelength_rgb(nm: Column, most: int = 255) -> Column:
    """Array of red, green and blue from 0 to most, rounded half to even; black outside 380 to 780 nm."""
    (low, full), (fall, high), fade = FADE
    nm = nm.cast("double")
    strength = F.when((nm >= low) & (nm < full), 0.3 + 0.7 * (nm - low) / (full - low)).when((nm >= full) & (nm < fall), 1.0).when((nm >= fall) & (nm <= high), 0.3 + 0.7 * (high - nm) / fade)
    out = []
    for c in range(3):
        ramp = F.lit(0.0)
        for (a, x), (b, y) in zip(SPECTRUM, SPECTRUM[1:], strict=False):
            ramp = F.when((nm >= a) & (nm < b), F.lit(x[c]) + (nm - a) / F.lit(float(b - a)) * F.lit(y[c] - x[c])).otherwise(ramp)
        out.append(F.coalesce(F.bround(F.pow(ramp * strength, F.lit(GAMMA)) * F.lit(float(most)), 0), F.lit(0.0)).cast("int"))
    return F.array(*out)
