"""Pitch flight, release and swing features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import as_col
from statloom.functions.numeric import round_half_even, round_half_up

RELEASE_Y = 50.0          # distance at which the flight parameters are given, ft
PLATE_Y = 17.0 / 12.0     # front of home plate, ft
TUNNEL_Y = PLATE_Y + 23.0  # decision point, ft


def total_movement(x, z) -> Column:
    x, z = as_col(x), as_col(z)
    return F.sqrt(x * x + z * z)


def spin_efficiency(x, z, spin) -> Column:
    """Movement per 1000 rpm; null when the ball is not spinning."""
    s = as_col(spin)
    return F.when(s > 0, total_movement(x, z) / (s / 1000))


def arm_side_break(x, throws) -> Column:
    return as_col(x) * F.when(as_col(throws) == "L", -1.0).otherwise(1.0)


def circular(angle) -> tuple[Column, Column]:
    """(sin, cos) of an angle in degrees."""
    r = F.radians(as_col(angle))
    return F.sin(r), F.cos(r)


def release_tilt(vy, vz) -> Column:
    return F.atan2(as_col(vz), -as_col(vy))


def same_side(throws, stands) -> Column:
    return F.coalesce(as_col(throws) == as_col(stands), F.lit(False)).cast("int")


def approach_angle_geometric(release_z, extension, plate_z=2.5, digits: int = 2) -> Column:
    """Straight line from release to plate, degrees; null when the distance is not positive."""
    z = as_col(plate_z) if isinstance(plate_z, (str, Column)) else F.lit(float(plate_z))
    dist = F.lit(60.5) - as_col(extension)
    return F.when(dist > 0, round_half_even(F.degrees(F.atan((z - as_col(release_z)) / dist)), digits))


def flight_angles(vx, vy, vz, ax, ay, az) -> tuple[Column, Column]:
    """(vertical, horizontal) angle at a flight time of 50/-vy held within 0.35..0.55 s."""
    vy, ay = as_col(vy), as_col(ay)
    raw = F.lit(RELEASE_Y) / (-vy)
    t = F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0.35)), F.lit(0.55)))
    forward = -(vy + ay * t)
    vertical = F.degrees(F.atan2(as_col(vz) + as_col(az) * t, forward))
    horizontal = F.degrees(F.atan2(as_col(vx) + as_col(ax) * t, forward))
    return vertical, horizontal


def approach_angle_at_plate(vy, vz, ay, az, plate_z=None, release_z=None, extension=None) -> Column:
    """Angle where the flight meets the plate, one decimal; straight line when that is undefined."""
    vy, vz, ay, az = (as_col(c) for c in (vy, vz, ay, az))
    disc = vy * vy - F.lit(2.0) * ay * F.lit(RELEASE_Y - PLATE_Y)
    t = F.when((disc >= 0) & (ay != 0), (-vy - F.sqrt(disc)) / ay)
    ok = (t > 0) & (t <= 1)
    angle = F.degrees(F.atan((vz + az * t) / F.abs(vy + ay * t)))
    kinematic = F.when(ok, round_half_up(angle, 1))
    if release_z is None:
        return kinematic
    dist = F.lit(60.5) - as_col(extension)
    straight = F.degrees(F.atan((as_col(plate_z) - as_col(release_z)) / dist))
    return F.coalesce(kinematic, F.when(dist > 0, round_half_up(straight, 1)))


def time_to(distance_y: float, vy, ay) -> Column:
    """Seconds from the parameter plane to a plane at distance_y; null if the flight never gets there."""
    vy, ay = as_col(vy), as_col(ay)
    a = F.lit(0.5) * ay
    disc = vy * vy - F.lit(4.0) * a * F.lit(RELEASE_Y - distance_y)
    return F.when((disc >= 0) & (ay != 0), (-vy - F.sqrt(disc)) / (F.lit(2.0) * a))


def tunnel_columns() -> dict[str, Column]:
    """Position at the decision point and the time left after it, from the usual pitch columns."""
    raw = time_to(TUNNEL_Y, "vy0", "ay")
    t = F.when((raw > 0) & (raw < 0.5), raw)
    half = F.lit(0.5)
    return {
        "tunnel_x": F.col("release_pos_x") + F.col("vx0") * t + half * F.col("ax") * t * t,
        "tunnel_z": F.col("release_pos_z") + F.col("vz0") * t + half * F.col("az") * t * t,
        "time_after_tunnel": time_to(PLATE_Y, "vy0", "ay") - t,
    }


def tunnel_distances() -> dict[str, Column]:
    """Separation from the pitcher's fastball in inches, at the decision point and at the plate."""
    dx = F.col("tunnel_x") - F.col("fb_tunnel_x")
    dz = F.col("tunnel_z") - F.col("fb_tunnel_z")
    px = F.col("plate_x") - F.col("fb_plate_x")
    pz = F.col("plate_z") - F.col("fb_plate_z")
    at_tunnel = F.sqrt(dx * dx + dz * dz) * 12
    at_plate = F.sqrt(px * px + pz * pz) * 12
    zero = F.lit(0.0)
    return {
        "tunnel_diff_x": F.coalesce(dx, zero),
        "tunnel_diff_z": F.coalesce(dz, zero),
        "tunnel_distance": F.coalesce(at_tunnel, zero),
        "plate_distance": F.coalesce(at_plate, zero),
        "late_break": F.coalesce(at_plate - at_tunnel, zero),
    }


def location_columns() -> dict[str, Column]:
    """Handedness-aware location features against the fixed 1.5-3.5 ft zone."""
    x, z = F.col("plate_x"), F.col("plate_z")
    zero = F.lit(0.0)
    off_x = F.when(x.isNotNull(), F.greatest(F.abs(x) - 0.83, zero))
    off_z = F.when(z.isNotNull(), F.greatest(z - 3.5, F.lit(1.5) - z, zero))
    return {
        "plate_x_adj": F.when(F.col("stand") == "L", -x).otherwise(x),
        "zone_center_dist": F.sqrt(x * x + (z - 2.5) * (z - 2.5)),
        "out_of_zone_dist": F.sqrt(off_x * off_x + off_z * off_z),
        "in_zone": F.coalesce((F.abs(x) <= 0.83) & z.between(1.5, 3.5), F.lit(False)).cast("int"),
        "same_side": same_side("p_throws", "stand"),
    }


def fastball_deltas() -> dict[str, Column]:
    """Difference to the pitcher's own fastball; a missing difference counts as 0."""
    zero = F.lit(0.0)
    pairs = {
        "delta_velo": ("release_speed", "fb_velo"),
        "delta_pfx_x": ("pfx_x", "fb_pfx_x"),
        "delta_pfx_z": ("pfx_z", "fb_pfx_z"),
        "delta_spin": ("release_spin_rate", "fb_spin"),
        "delta_extension": ("release_extension", "fb_extension"),
        "delta_vaa": ("vaa", "fb_vaa"),
        "release_diff_x": ("release_pos_x", "fb_release_x"),
        "release_diff_z": ("release_pos_z", "fb_release_z"),
    }
    d = {k: F.col(a) - F.col(b) for k, (a, b) in pairs.items()}
    d["movement_separation"] = total_movement(d["delta_pfx_x"], d["delta_pfx_z"])
    d["release_distance"] = total_movement(d["release_diff_x"], d["release_diff_z"])
    return {k: F.coalesce(v, zero) for k, v in d.items()}


def swing_columns() -> dict[str, Column]:
    """Swing features from tracked bat and pitch columns."""
    diff = F.sqrt(F.col("plate_x") * F.col("plate_x") + (F.col("plate_z") - 2.5) * (F.col("plate_z") - 2.5))
    max_ev = F.lit(1.23) * F.col("bat_speed") + F.lit(0.23) * F.col("release_speed")
    return {
        "ideal_attack_angle": F.coalesce(F.col("attack_angle").between(5, 20), F.lit(False)).cast("int"),
        "location_difficulty": diff,
        "count_leverage": F.col("balls") - F.col("strikes"),
        "directional_match": -F.col("attack_direction") * F.col("plate_x"),
        "speed_differential": F.col("bat_speed") - F.col("release_speed") * 0.7,
        "speed_vs_location": F.col("bat_speed") * (F.lit(1.0) + F.lit(0.3) * diff),
        "theoretical_max_ev": max_ev,
        "squared_up_rate": F.when(max_ev != 0, F.col("launch_speed") / max_ev),
    }


def swing_value(quality, contact) -> Column:
    """quality^1.5 * contact^0.3, both floored at 0.001."""
    q = F.when(as_col(quality).isNotNull(), F.greatest(as_col(quality), F.lit(0.001)))
    c = F.when(as_col(contact).isNotNull(), F.greatest(as_col(contact), F.lit(0.001)))
    return F.pow(q, F.lit(1.5)) * F.pow(c, F.lit(0.3))
