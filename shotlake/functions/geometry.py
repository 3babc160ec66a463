"""Pitch geometry: the goal line is x = 120, its posts at y = 36 and 44."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pitch length and width, measured overshoot of x with its tolerance, goal centre and posts.
LENGTH, WIDTH, LAST_X, TOLERANCE, CENTRE, LOW_POST, HIGH_POST = 120.0, 80.0, 120.1, 1e-12, 40.0, 36.0, 44.0


def effective_x(x: Column) -> Column:
    """x, with the measured overshoot moved back to the goal line."""
    return F.when((x > LENGTH) & (x <= LAST_X + TOLERANCE), F.lit(LENGTH)).otherwise(x)


def location_error(x: Column, y: Column) -> Column:
    """Why a location can't be used, or null."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return (
        F.when(x.isNull() | y.isNull(), "missing")
        .when(bad(x) | bad(y), "not finite")
        .when((x < 0) | (x > LAST_X + TOLERANCE), "x out of range")
        .when((y < 0) | (y > WIDTH), "y out of range")
        .when((effective_x(x) == LENGTH) & y.isin(LOW_POST, HIGH_POST), "on a post")
    )


def distance_to_goal(x: Column, y: Column) -> Column:
    """The root of the sum of squares, by the operations in the SQL: hypot() rounds otherwise in the last digit, which puts
    shots at 10, 20 or 30 yards into another band."""
    dx, dy = F.lit(LENGTH) - x, y - F.lit(CENTRE)
    return F.sqrt(dx * dx + dy * dy)


def visible_goal_angle(x: Column, y: Column) -> Column:
    """Angle between the lines to both posts, from 0 to pi."""
    dx, low, high = F.lit(LENGTH) - x, F.lit(LOW_POST) - y, F.lit(HIGH_POST) - y
    return F.atan2(dx * (high - low), dx * dx + low * high)
