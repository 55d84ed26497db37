import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from statloom.functions import buckets, curve, dates, names, numeric, physics, sql


def test_rounding_modes(one):
    assert one(numeric.round_half_even("x", 1), x=0.25) == 0.2
    assert one(numeric.round_half_even("x", 1), x=0.75) == 0.8
    assert one(numeric.round_half_up("x", 1), x=0.25) == 0.3
    assert one(numeric.round_half_up("x", 0), x=-2.5) == -2.0


def test_missing_values(one):
    assert one(numeric.clip("x", 0.0, 1.0), x=5.0) == 1.0
    assert one(numeric.clip(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert one(numeric.safe_ratio("n", "d"), n=1.0, d=0.0) is None
    assert one(numeric.to_number("x"), x="abc") is None
    assert one(numeric.to_number("x"), x="NaN") is None
    assert one(numeric.parse_positive("x"), x="'.504") == 0.504
    assert one(numeric.parse_positive("x"), x="'-0.08") is None
    assert one(numeric.percent_repair("x"), x=45.0) == 0.45
    assert one(numeric.display("x", 1, 100.0), x=0.456) == "45.6"
    assert one(numeric.display(F.lit(None).cast("double"), 1)) == "—"


def test_weighted_mean_renormalises(one):
    null = F.lit(None).cast("double")
    assert one(numeric.weighted_mean_present([F.lit(10.0), null, F.lit(40.0)], [F.lit(1.0), F.lit(5.0), F.lit(3.0)])) == 32.5
    assert one(numeric.weighted_mean_present([null], [F.lit(1.0)])) is None


@pytest.mark.parametrize("text,suffix,ascii_,token", [
    ("José Ramírez Jr.", "jose ramirez", "jose ramirez jr", "jose ramirez"),
    ("Jean-Luc O'Neil", "jean luc o'neil", "jeanluc oneil", "jeanluc o'neil"),
    ("J.T. Miller (LW)", "jt miller (lw)", "jt miller", "jt miller (lw)"),
    ("De La Cruz, Elly  II", "de la cruz elly", "de la cruz, elly ii", "de la cruz elly"),
])
def test_name_keys(one, text, suffix, ascii_, token):
    assert one(names.name_key("x", "suffix"), x=text) == suffix
    assert one(names.name_key("x", "ascii"), x=text) == ascii_
    assert one(names.name_key("x", "token"), x=text) == token


def test_accent_table_matches_unicode(spark):
    chars = [chr(c) for c in list(range(0xC0, 0x250)) + list(range(0x1E00, 0x1F00))]
    got = spark.createDataFrame([(c,) for c in chars], "c string").select("c", names.fold_accents("c").alias("f")).collect()
    for r in got:
        want = "".join(x for x in unicodedata.normalize("NFD", r["c"]) if unicodedata.category(x) != "Mn")
        assert r["f"] == want


def test_teams_positions_labels(one):
    assert one(names.standard_team("x"), x="BOS, t.b") == "TBL"
    assert one(names.position_group("x"), x="C, LW") == "F"
    assert one(names.position_group("x"), x="ld") == "D"
    assert one(names.position_group("x"), x="G") is None
    assert one(names.flip_last_first("x"), x="Judge, Aaron") == "Aaron Judge"
    assert one(names.season_label(F.lit(2025))) == "25-26"
    assert one(names.season_span(F.lit(2025))) == "20252026"
    assert one(names.pitch_key(F.lit(7), F.lit(3), F.lit(2))) == "7_2_2"
    assert one(names.pitch_name(F.lit("ZZ"))) == "ZZ"


@pytest.mark.parametrize("angle,bucket", [(-10.0, 0), (-9.9, 1), (-5.0, 1), (0.0, 2), (40.0, 10), (40.1, 11)])
def test_angle_bucket(one, angle, bucket):
    assert one(buckets.angle_bucket("x"), x=angle) == bucket


def test_count_buckets(one):
    want = {(0, 0): "first", (0, 2): "ahead", (1, 1): "even", (3, 0): "behind", (3, 2): "full", (2, 2): "even", (3, 1): "behind"}
    for (b, s), name in want.items():
        assert one(buckets.count_bucket("b", "s"), b=b, s=s) == name


def test_zone_is_tri_state(one):
    z = buckets.in_zone("x", F.lit(2.0), None, None)
    assert one(z, x=0.83) is True
    assert one(z, x=0.84) is False
    assert one(buckets.in_zone(F.lit(None).cast("double"), F.lit(2.0))) is None
    assert one(buckets.in_zone(F.lit(0.0), F.lit(1.45), F.lit(3.0), F.lit(0.0))) is False


def test_event_outs(one):
    for e, n in {"grounded_into_double_play": 2, "triple_play": 3, "field_out": 1, "single": 0, "field_error": 1}.items():
        assert one(buckets.event_outs("x"), x=e) == n


def test_bands_tiers_effectiveness(one):
    assert one(buckets.percentile_band("x"), x=90.0) == "90-100"
    assert one(buckets.percentile_band(F.lit(None).cast("double"))) == "NA"
    assert one(buckets.rating_tier("x"), x=84) == "Poor"
    assert one(buckets.effectiveness("x", F.lit(10.0), F.lit(2.0)), x=10.1) == 0.0
    assert one(buckets.effectiveness("x", F.lit(10.0), F.lit(2.0), False), x=20.0) == -1.0
    assert one(buckets.expected_slugging(F.lit(12.0), F.lit(105.0))) == 2.20


def test_stretch_matches_integral(spark):
    def integral(x, n=20000):
        # substitution t = s^4 smooths the end points
        if x <= 0:
            return 0.0
        top, total = x ** 0.25, 0.0
        for i in range(n):
            s = (i + 0.5) / n * top
            t = s ** 4
            total += (t ** 0.3) * ((1 - t) ** 0.3) * 4 * s ** 3
        return total * top / n * math.gamma(2.6) / math.gamma(1.3) ** 2

    ps = [0.0, 5.0, 30.0, 49.25, 60.0, 90.0, 98.5, 100.0]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(curve.stretch_percentile("p")).collect()]
    for p, g in zip(ps, got):
        assert abs(g - 100 * integral(min(p / 98.5, 1))) < 1e-3
    assert got[0] == 0.0 and got[-1] == 100.0 and got == sorted(got)


def test_innings(one):
    assert one(dates.outs_to_innings(F.lit(70))) == 23.1
    assert one(dates.outs_to_innings(F.lit(70), compat=True)) == 23.4
    assert one(dates.innings_to_outs("x"), x="5.2") == 17
    assert one(dates.innings_to_outs("x"), x="4") == 12


def test_flight(one):
    assert one(physics.approach_angle_geometric(F.lit(6.0), F.lit(60.5))) is None
    assert one(physics.spin_efficiency(F.lit(1.0), F.lit(1.0), F.lit(0.0))) is None
    assert one(physics.time_to(physics.PLATE_Y, F.lit(-1.0), F.lit(60.0))) is None
    t = one(physics.time_to(physics.PLATE_Y, F.lit(-130.0), F.lit(25.0)))
    assert abs(50 - 130 * t + 12.5 * t * t - 17 / 12) < 1e-9
    assert one(physics.approach_angle_at_plate(
        F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(6.0), F.lit(6.5))) == -4.2


def test_sql_functions(spark):
    assert "name_key" in sql.register(spark)
    r = spark.sql("SELECT round_half_up(0.25D, 1) a, round_to_even(0.25D, 1) b, angle_bucket(-10D) c, angle_bucket(NULL) d, "
                  "count_bucket(3, 2) e, name_key('José Núñez Jr.') f, outs_to_innings(70) g, stretch_percentile(100D) h").first()
    assert tuple(r) == (0.3, 0.2, 0, None, "full", "jose nunez", 23.1, 100.0)
