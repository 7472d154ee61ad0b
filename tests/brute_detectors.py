"""The detectors once more, from their formulas: every event looks at the whole history again.

Written against the rules, not against ``bookloom.operators.detectors``: there is no state
that is kept up to date, only lists of what has happened. For small streams. Events are
(place, type, side, price, quantity, order id, time); flags are (start, end, severity, ...).
"""

from __future__ import annotations

import statistics

ADD, CANCEL, MODIFY, TRADE = 1, 2, 3, 4


def unit(x):
    return max(0.0, min(1.0, x))


def resolved(events):
    """What each event does to resting depth: (what, side, price, quantity, event's place) or None, by all orders so far."""
    orders, out = {}, []
    for place, et, side, price, qty, oid, _ in events:
        found = None
        if et == ADD:
            found = ("add", side, price, qty, place)
            if oid:
                orders[oid] = (side, price, qty)
        elif et in (CANCEL, TRADE) and oid in orders and oid:
            s, p, held = orders[oid]
            taken = held if qty == 0 else min(qty, held)
            if taken == held:
                del orders[oid]
            else:
                orders[oid] = (s, p, held - taken)
            found = ("sub", s, (price or p) if et == TRADE else p, taken, place)
        elif et in (CANCEL, TRADE) and (price or not oid):
            found = ("sub", side, price, qty, place)
        out.append(found)
    return out


def book_after(done):
    """Quantity by price of both sides, from all that was done; no more than 64 levels are expected."""
    sides = ({}, {})
    for what, side, price, qty, _ in filter(None, done):
        held = sides[side].get(price)
        if what == "add":
            sides[side][price] = (held or 0) + qty
        elif held is not None:
            if qty and qty < held:
                sides[side][price] = held - qty
            else:
                del sides[side][price]
    assert max(map(len, sides)) <= 64
    return sides


def top(sides):
    return max(sides[0], default=None), min(sides[1], default=None)


def mid_of(sides):
    bid, ask = top(sides)
    return None if bid is None or ask is None or ask < bid else (bid + ask) // 2


def bps(a, b):
    return abs(b - a) * 10_000 // a if a else 0


def quote_stuff(events, size, ratio):
    out = []
    for i, e in enumerate(events):
        if e[1] not in (ADD, CANCEL, TRADE):
            continue
        last = [x for x in events[: i + 1] if x[1] in (ADD, CANCEL, TRADE)][-size:]
        r = sum(x[1] == CANCEL for x in last) / max(sum(x[1] == TRADE for x in last), 1)
        if r >= ratio and len(last) >= size // 2:
            out.append((last[0][0], e[0], min(r / ratio / 2, 1), len(last)))
    return out


def spoof(events, large, within):
    out = []
    for i, e in enumerate(events):
        if e[1] != CANCEL:
            continue
        adds = [x for x in events[:i] if x[1] == ADD and x[5] == e[5] and x[4] >= large]
        if adds and not any(x[1] == CANCEL and x[5] == e[5] and x[0] > adds[0][0] for x in events[:i]) and e[0] - adds[0][0] <= within:
            out.append((adds[0][0], e[0], min(adds[0][4] / large / 5, 1), 2))
    return out


def phantom(events, span, least_qty):
    """A cancel closes the ledger of its order's price that began with the first add after the last trade or close there."""
    out, closed = [], {}
    for i, e in enumerate(events):
        if e[1] != CANCEL:
            continue
        before = events[:i]
        adds = [x for x in before if x[1] == ADD and x[5] == e[5]]
        if not adds or any(x[1] == CANCEL and x[5] == e[5] and x[0] > adds[-1][0] for x in before):
            continue
        key = adds[-1][2:4]
        ends = [x[0] for x in before if x[1] == TRADE and x[2:4] == key] + closed.get(key, [])
        since = max(ends, default=-1)
        opened = [x for x in before if x[0] > since and x[1] == ADD and x[2:4] == key]
        if not opened:
            continue
        added = cancelled = n_adds = n_cancels = 0
        for x in [*(y for y in before if y[0] >= opened[0][0]), e]:
            if x[1] == ADD and x[2:4] == key:
                added, n_adds = added + x[4], n_adds + 1
            elif x[1] == CANCEL:
                own = [y for y in events[: x[0]] if y[1] == ADD and y[5] == x[5] and y[0] < x[0]]
                again = own and any(y[1] == CANCEL and y[5] == x[5] and own[-1][0] < y[0] < x[0] for y in events)
                if own and not again and own[-1][2:4] == key:
                    cancelled += x[4] or max(added - cancelled, 1) // max(n_adds, 1)
                    n_cancels += 1
        if cancelled >= added and n_cancels >= n_adds:
            closed.setdefault(key, []).append(e[0])
            took = e[0] - opened[0][0]
            if added >= least_qty and took <= span:
                out.append((opened[0][0], e[0], unit(1 - took / span), n_adds + n_cancels))
    return out


def storm(events, span, least, warmup, floor, sigmas, row, cooldown):
    out, learned, above, quiet = [], [], [], 0
    counted = [e for e in events if e[1] in (ADD, CANCEL, TRADE)]
    for e in counted:
        window = [x for x in counted if e[0] - span <= x[0] <= e[0]]
        if len(window) < least:
            continue
        rate = sum(x[1] == CANCEL for x in window) / len(window)
        if len(learned) < warmup:
            learned.append(rate)
            continue
        mean = statistics.fmean(learned)
        sigma = max(statistics.stdev(learned), floor)
        if rate <= mean + sigmas * sigma:
            above = []
            if e[0] >= quiet:
                learned.append(rate)
            continue
        above.append(e[0])
        if len(above) >= row and e[0] >= quiet:
            z = (rate - mean) / sigma
            out.append((above[0], e[0], unit(z / (z + 3)), len(window)))
            quiet, above = e[0] + cooldown, []
    return out


def sign(x):
    return (x > 0) - (x < 0)


def ignition(events, span, least_bps, trades, run_length, cooldown):
    out, done = [], resolved(events)
    moves = []  # (place, mid, whether no earlier move was remembered)
    forgot, reset, quiet, broke = True, -1, 0, -1
    for i, e in enumerate(events):
        mid = mid_of(book_after(done[: i + 1]))
        if e[1] not in (ADD, CANCEL, MODIFY, TRADE) or mid is None:
            continue
        if forgot or moves[-1][1] != mid:
            moves.append((e[0], mid, forgot))
            forgot = False
        elif e[0] - moves[-1][0] > span:
            forgot, reset = True, e[0]
        steps = []
        for a, b in zip(moves[-2::-1], moves[:0:-1]):
            if b[2] or b[0] - a[0] > span or b[0] <= broke or (steps and sign(b[1] - a[1]) != steps[0]):
                break
            steps.append(sign(b[1] - a[1]))
        if not steps or len(steps) + 1 < run_length or e[0] < quiet:
            continue
        pushes = [d[1] for x, d in zip(events[: i + 1], done) if x[1] == TRADE and d and x[0] > reset]
        start = moves[-1 - len(steps)]
        along = pushes.count(1 if steps[0] > 0 else 0)
        if len(pushes) >= trades and bps(start[1], mid) >= least_bps and 2 * along > len(pushes):
            severity = 0.6 * unit(bps(start[1], mid) / (4 * least_bps)) + 0.4 * unit((along / len(pushes) - 0.5) * 2)
            out.append((start[0], e[0], unit(severity), len(pushes)))
            quiet, broke = e[0] + cooldown, e[0]
    return out


def band(sides, bid, ask, ticks):
    low, high = max(bid - ticks, 0), ask + ticks
    return sum(q for p, q in sides[0].items() if low <= p <= bid) + sum(q for p, q in sides[1].items() if ask <= p <= high)


def crash(events, gap_bps, within, ticks, drop, trades, cooldown):
    out, done, snaps = [], resolved(events), []
    cleared, quiet, counted = -1, 0, -1
    for i, e in enumerate(events):
        before, after = book_after(done[:i]), book_after(done[: i + 1])
        if mid_of(before) is not None:
            bid, ask = top(before)
            snaps.append((e[0], mid_of(before), bid, ask, band(before, bid, ask, ticks)))
        mid = mid_of(after)
        if e[1] not in (ADD, CANCEL, MODIFY, TRADE) or mid is None:
            continue
        if e[0] < quiet:
            counted = e[0]
            continue
        near = [s for s in snaps[-within - 1 :] if s[0] > cleared and 0 < e[0] - s[0] <= within and s[1] != mid and bps(s[1], mid) >= gap_bps]
        if not near:
            continue
        place, then, bid, ask, depth = near[0]
        lost = max(depth - band(after, bid, ask, ticks), 0)
        pushes = [d[1] for x, d in zip(events[: i + 1], done) if x[1] == TRADE and d and x[0] > counted]
        along = pushes.count(0 if mid < then else 1)
        if not depth or lost / depth < drop or along < trades:
            continue
        severity = 0.5 * unit(bps(then, mid) / (4 * gap_bps)) + 0.3 * unit(lost / depth) + 0.2 * along / max(len(pushes), 1)
        out.append((place, e[0], unit(severity), e[0] - place))
        cleared, quiet, counted = e[0], e[0] + cooldown, e[0]
    return out


def reaction(events, span, ticks, large, burst, cooldown):
    out, done, quiet, triggers = [], resolved(events), 0, []
    for i, e in enumerate(events):
        if e[1] not in (ADD, CANCEL, MODIFY, TRADE):
            continue
        d = done[i]
        if e[1] == TRADE and d and d[3] >= large and mid_of(book_after(done[:i])) is not None and e[0] >= quiet:
            triggers.append((e[0], d[1], d[2]))
        assert sum(e[0] - t[0] <= span for t in triggers) <= 64
        for place, side, price in triggers:
            hits = [x for x in events[: i + 1] if x[0] > place and x[0] - place <= span and x[1] in (ADD, CANCEL) and x[2] == 1 - side and abs(x[3] - price) <= ticks]
            if len(hits) >= burst and hits[burst - 1][0] == e[0]:
                out.append((place, e[0], unit(0.6 * (1 - unit((e[0] - place) / span)) + 0.4 * unit(1 / 4)), burst))
                quiet = e[0] + cooldown
                break
    return out
