import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail import schema
from kinetrail.functions import codecs, geometry, scalars
from kinetrail.operators import filters, sequences, sharding, temporal


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def numbers(*values):
    return F.array(*[F.lit(None).cast("double") if v is None else F.lit(float(v)) for v in values])


def test_codecs_undo_themselves(spark):
    x, low, high = F.lit(3.5), F.lit(1.0), F.lit(6.0)
    for codec in (codecs.min_max(low, high), codecs.quantile(low, high), codecs.mean_std(low, high), codecs.min_max(low, high) + codecs.mean_std(F.lit(0.1), F.lit(2.0))):
        assert one(spark, codec.decode(codec.encode(x)))[0] == pytest.approx(3.5)
    assert one(spark, codecs.min_max(low, high, clamp=True).encode(F.lit(99.0)))[0] == 1.0
    got = one(spark, codecs.over_joints(numbers(1, 5), numbers(0, 0), numbers(2, 10), codecs.min_max))[0]
    assert got == pytest.approx([0, 0], abs=1e-6)


def test_cosine_tokens_come_back(spark):
    steps = [0.1, 0.5, -0.3, 0.9, 0.0, 0.2]
    tokens = codecs.dct_tokens(numbers(*steps), 6, 1000, -4000)
    back, text = one(spark, codecs.from_dct_tokens(tokens, 6, 1000, -4000), codecs.token_text(tokens))
    assert back == pytest.approx(steps, abs=2e-3) and len(text) == 6


def test_poses(spark):
    q, t = [0.5, 0.5, -0.5, 0.5], [1, 2, 3]
    m = geometry.pose_matrix(numbers(*t), numbers(*q))
    whole, same = one(spark, m, geometry.product(m, geometry.inverse_rigid(m)))
    assert same == pytest.approx(np.eye(4).ravel().tolist(), abs=1e-12)
    r = np.array(whole).reshape(4, 4)[:3, :3]
    assert np.allclose(r @ r.T, np.eye(3)) and np.isclose(np.linalg.det(r), 1)
    down = one(spark, geometry.angle_to_vertical(geometry.pose_matrix(numbers(0, 0, 0), numbers(0, 1, 0, 0))))[0]
    assert down == pytest.approx(0, abs=1e-5)
    turned = np.array(one(spark, geometry.euler_matrix([F.lit(math.pi / 2), F.lit(0.0), F.lit(0.0)]))[0]).reshape(3, 3)
    assert np.allclose(turned, [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    box = one(spark, geometry.corners([F.lit(0.0)] * 3, [F.lit(2.0), F.lit(4.0), F.lit(6.0)]))[0]
    assert sorted(map(tuple, box)) == sorted((x, y, z) for x in (-1, 1) for y in (-2, 2) for z in (-3, 3))


def test_grasps(spark):
    got = one(spark, geometry.grasp_decoded(numbers(0, 0, 0.5, 0.5, 0, 0), numbers(0, 3, 1), numbers(1, 0, 5), F.lit(0.4)))[0]
    assert (got.score, got.depth, got.width) == pytest.approx((0.5, 0.03, 0.1)) and got.angle == pytest.approx(math.pi / 12)


def test_padding_and_resampling(spark):
    got = one(spark, sequences.pad_ends(numbers(None, 1, None, 2, None)), sequences.pad_ends(numbers(None, None)), sequences.resample(numbers(0, 1, 2, 3), 2), sequences.resample(numbers(0, 1, 2, 3), 0.5), sequences.linear(numbers(7), 3))
    assert got[0] == [1, 1, None, 2, 2] and got[1] == [None, None] and got[2] == [0, 2]
    assert got[3] == pytest.approx(np.interp(np.linspace(0, 3, 8), range(4), range(4)).tolist()) and got[4] == [7, 7, 7]
    with pytest.raises(Exception, match="nothing to pad"):
        one(spark, sequences.pad_ends(F.array().cast("array<double>")))
    assert one(spark, sequences.jerk(numbers(0, 1, 8, 27, 64)))[0] == 6.0
    assert one(spark, sequences.delta(numbers(3, 4), numbers(1)))[0] == [2, 3]
    assert one(spark, sequences.velocity(numbers(0, 1, 3), F.array(*[F.lit(k * 10**9) for k in range(3)])))[0] == [1, 1, 2]


def test_scalars(spark):
    got = one(spark, scalars.downscaled(F.lit(5), 0.5), scalars.downscaled(F.lit(1), 0.1), scalars.clean_descriptions(F.array(*map(F.lit, (" a", "b", "", "a ")))), scalars.from_base64_json(scalars.to_base64_json(F.struct(F.lit(3).alias("x"))), "x int"))
    assert got[0] == 2 and got[1] == 1 and got[2] == ["a", "b"] and got[3].x == 3
    assert temporal.nanoseconds(-0.04) == -40_000_000 and temporal.nanoseconds(1.5) == 1_500_000_000
    u, n = zip(*spark.range(4000).select(scalars.uniform(3, F.col("id")), scalars.gaussian(4, F.col("id"))).collect(), strict=True)
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.03 and abs(np.std(n) - 1) < 0.05


def test_intervals_and_limits(spark):
    lit = F.lit
    got = one(spark, filters.overlaps(lit(1), lit(3), lit(3), lit(4)), filters.interval_iou(lit(0), lit(4), lit(2), lit(6)), filters.within_limits(numbers(1, -3.2), 3.14), filters.clipped(numbers(1, -3.2), 3.14))
    assert got[0] and got[1] == pytest.approx(1 / 3) and not got[2] and got[3] == [1, -3.14]
    assert sharding.nested_shard(3, 2, 4, 1) == (12, 9)
    with pytest.raises(ValueError):
        sharding.target_rows(5, float("inf"))
    assert [sharding.target_rows(5, r) for r in (0.5, 0.3, 1.5)] == [2, 2, 8]


def test_strict_json_and_reserved_names():
    assert schema.strict_json({"a": [1, 2.5, None, {"b": "c"}]}) and not schema.strict_json({"a": float("nan")}) and not schema.strict_json({1: 2})
    with pytest.raises(ValueError):
        schema.refuse_reserved("index")


def test_action_text_comes_back_or_is_refused(spark):
    steps = F.array(*[F.array(*map(F.lit, s)) for s in ([1, 2, 3], [5, 6, 7])])
    text, back = one(spark, codecs.action_text(steps, 1), codecs.from_action_text(codecs.action_text(steps, 1), 3, 1))
    assert text == "<arm>\x01\x02\x05\x06<gripper>\x03\x07" and back == [[1, 2, 3], [5, 6, 7]]
    lines = F.lit("<arm>\n\r\u2028a<gripper>\n\x85")
    assert one(spark, codecs.from_action_text(lines, 3, 1))[0] == [[10, 13, 10], [0x2028, 97, 0x85]]
    for bad in ("<arm>ab", "ab<gripper>c", "<arm>ab<arm>cd<gripper>ef", "<arm>abc<gripper>d", "<arm>ab<gripper>cd", None):
        assert one(spark, codecs.from_action_text(F.lit(bad).cast("string"), 3, 1))[0] is None
    assert one(spark, codecs.from_action_text(F.lit("<arm><gripper>"), 3, 1))[0] == []


def test_link_poses_against_matrices(spark):
    rng = np.random.default_rng(3)

    def rigid():
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = q * np.sign(np.linalg.det(q)), rng.normal(size=3)
        return m

    def turned(axis, angle):
        k = np.array(axis) / np.linalg.norm(axis)
        cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        m = np.eye(4)
        m[:3, :3] = np.eye(3) + math.sin(angle) * cross + (1 - math.cos(angle)) * cross @ cross
        return m

    origins, axes = [rigid() for _ in range(4)], [tuple(rng.normal(size=3)) for _ in range(4)]
    kinds, values = ["turn", "slide", "fixed", "turn"], [0.7, -0.4, 2.1]
    slid = np.eye(4)
    slid[:3, 3] = -0.4 * np.array(axes[1]) / np.linalg.norm(axes[1])
    want, at = [], np.eye(4)
    for origin, moved in zip(origins, [turned(axes[0], 0.7), slid, np.eye(4), turned(axes[3], 2.1)], strict=True):
        at = at @ origin @ moved
        want.append(at.ravel())
    chain = [geometry.Joint(tuple(o.ravel().tolist()), a, k) for o, a, k in zip(origins, axes, kinds, strict=True)]
    assert np.allclose(one(spark, geometry.link_poses(chain, numbers(*values)))[0], want)
    assert one(spark, geometry.link_poses(chain, numbers(0.7, None, 2.1)))[0] is None
    assert one(spark, geometry.link_poses(chain, numbers(0.7)))[0] is None
    camera = rigid()
    seen = one(spark, geometry.base_to_camera(numbers(*camera.ravel()), numbers(*want[-1])))[0]
    assert np.allclose(seen, np.linalg.inv(np.reshape(want[-1], (4, 4)) @ camera).ravel())
    with pytest.raises(ValueError, match="turns, slides"):
        geometry.Joint(kind="spins").pose(F.lit(1.0))
