"""Derived quantities that the factors share, as staged expressions over columns o, h, l, c, v.

Least numbers of values (``mp``) and the constants are fixed values of the factor definitions.
"""

from __future__ import annotations

from crosswind.functions.expr import E, X, absolute, clip, coalesce, col, greatest, held, if_, lag, lift, ln, neg_part, pos, roll, roll2, sign, sqrt, xrank, xs

o, h, l, c, v = (col(n) for n in "ohlcv")  # noqa: E741


def ravg(x, w, mp):
    return roll("avg", x, w, mp)


def rsum(x, w, mp):
    return roll("sum", x, w, mp)


def rmax(x, w, mp):
    return roll("max", x, w, mp)


def rmin(x, w, mp):
    return roll("min", x, w, mp)


def rstd(x, w, mp):
    return roll("stddev_samp", x, w, mp)


def rvar(x, w, mp):
    return roll("var_samp", x, w, mp)


def rmed(x, w, mp):
    return roll("quantile", x, w, mp, 0.5)


ret = held(c / lag(c) - 1)
mkt = held(coalesce(xs("avg", ret), 0.0))
dv = held(c * v)


def pct(k: int) -> X:
    return c / lag(c, k) - 1


def grown(k: int) -> X:
    """Return over k rows with a guarded denominator."""
    return held(c / (lag(c, k) + E) - 1)


r3, r5, r21, r63 = (grown(k) for k in (3, 5, 21, 63))
sv = held(sign(c - lag(c)) * v)


def pcov(x, y, w, mp):
    """Mean of products less product of means, each over its own values."""
    return ravg(x * y, w, mp) - ravg(x, w, mp) * ravg(y, w, mp)


def acf1(x, w, mp, mp_std=None):
    before, m = lag(x), mp_std if mp_std is not None else max(2, w // 2)
    return pcov(x, before, w, mp) / (rstd(x, w, m) * rstd(before, w, m) + E)


def beta(w, mp=None):
    mp = max(10, w // 2) if mp is None else mp
    return held(roll2("covar_samp", ret, mkt, w, mp) / (rvar(mkt, w, mp) + E))


resid = held(ret - lag(beta(126)) * mkt)


def cbeta(cond: X, w: int, mp: int) -> X:
    """Beta over the rows where the market condition holds."""
    x, y = held(if_(cond, ret)), held(if_(cond, mkt))
    return roll2("covar_samp", x, y, w, mp) / (rvar(y, w, mp) + E)


def ofi(w: int) -> X:
    mp = max(2, w // 2)
    return clip(rsum(sv, w, mp) / (rsum(v, w, mp) + E), -1.0, 1.0)


def vpin(w: int) -> X:
    mp = max(2, w // 2)
    buy, sell = rsum(pos(sv), w, mp), rsum(-neg_part(sv), w, mp)
    return absolute(buy - sell) / (buy + sell + E)


class Ou:
    """A first-order autoregression of log prices read as a mean-reverting process."""

    def __init__(self, w: int):
        mp = max(5, w // 2)
        x = held(ln(c))
        before = lag(x)
        mx, ml = ravg(x, w, mp), ravg(before, w, mp)
        b = held(clip(pcov(x, before, w, mp) / (rvar(before, w, mp) + E), -0.9999, 0.9999))
        a = held(mx - b * ml)
        self.theta = held(greatest(-ln(absolute(b) + E), lift(E)))
        self.mu = held(a / (1.0 - b + E))
        self.sigma = rstd(x - (a + b * before), w, mp)
        self.half_life = clip(ln(lift(2.0)) / self.theta, 2.0, 42.0)
        self.z = clip((x - self.mu) / (self.sigma + E), -3.0, 3.0)
        self.x = x


pc = lag(c)
tr = greatest(h - l, absolute(h - pc), absolute(l - pc))


def atr(n: int) -> X:
    return ravg(tr, n, max(5, n // 2))


cloc = clip((c - l) / (h - l + E) - 0.5, -0.5, 0.5)
cpos = pos(cloc)


def rdv(short: int, long: int) -> X:
    return clip(ravg(dv, short, max(2, short // 2)) / (rmed(dv, long, max(10, long // 2)) + E), 0.1, 6.0)


on = held(o / (lag(c) + E) - 1)
intra = held(c / (o + E) - 1)


def down() -> X:
    """Days on which the market fell by over half its usual move; where those are few, all on which it fell."""
    strict = mkt < -0.5 * coalesce(rstd(mkt, 63, 31), 0.0)
    many = rsum(if_(strict, 1.0, 0.0), 63, 1) >= 6.0
    return held(if_(many, if_(strict, 1.0, 0.0), if_(mkt < 0.0, 1.0, 0.0))) > 0.5


def zs(x: X) -> X:
    """Distance from the date's median in scaled median absolute deviations, within 5."""
    x = held(x)
    m = xs("median", x)
    return clip((x - m) / (1.4826 * xs("median", absolute(x - m)) + E), -5.0, 5.0)


def xrank2(x: X) -> X:
    return held((xrank(x) - 0.5) * 2.0)


def breadth() -> X:
    return ravg(xs("avg", if_(ret > 0.0, 1.0, 0.0)), 5, 2)
