"""What R1-R3 and R5 should return, worked out in plain Python from collected snapshot rows."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import groupby

from tests.conftest import snap_row

C, CAT, V, CH = "video_trending_country", "video_category_id", "video_id", "channel_title"


def low(v):
    """Ascending, missing values last."""
    return (v is None, 0 if v is None else v)


def high(v):
    """Descending, missing values last."""
    return (v is None, 0 if v is None else -v)


def most(values):
    return max((v for v in values if v is not None), default=None)


def total(values):
    known = [v for v in values if v is not None]
    return sum(known) if known else None


def bundles(rows, *keys, needed=()):
    out = defaultdict(list)
    for r in rows:
        if all(r[k] is not None for k in needed):
            out[tuple(r[k] for k in keys)].append(r)
    return out


def best(entries, k):
    """The first ``k`` of each place with their ranks; ``entries`` are (place, sort key, values)."""
    out = []
    for _, same in groupby(sorted(entries, key=lambda e: (str(e[0]), e[1])), key=lambda e: str(e[0])):
        out += [(*e[2], rank) for rank, e in enumerate(same, 1) if rank <= k]
    return out


def categories(rows, k=10):
    found = []
    for (country, cat), seen in bundles(rows, C, CAT, needed=(C, CAT)).items():
        videos = bundles(seen, V).values()
        views = [most(r["video_view_count"] for r in v) for v in videos]
        known = [v for v in views if v is not None]
        mean = (2 * sum(known) + len(known)) // (2 * len(known)) if known else None
        likes = total(most(r["video_like_count"] for r in v) for v in videos)
        found.append((country, (-len(seen), high(total(views)), cat), (country, cat, len(seen), total(views), mean, likes)))
    return best(found, k)


def channels(rows, k=10):
    found = []
    for (country, title, cat), seen in bundles(rows, C, CH, CAT, needed=(C, CH, CAT)).items():
        videos = bundles(seen, V).values()
        views = total(most(r["video_view_count"] for r in v) for v in videos)
        url = min((r["channel_custom_url"] for r in seen if r["channel_custom_url"] is not None), default=None)
        subs, own = (most(r[c] for r in seen) for c in ("channel_subscriber_count", "channel_view_count"))
        found.append((country, (-len(seen), high(views), title, cat), (country, title, url, cat, len(seen), views, len(videos), subs, own)))
    return best(found, k)


def rating(r):
    views = r["video_view_count"]
    return round(((r["video_like_count"] or 0) + (r["video_comment_count"] or 0)) / views * 100, 4) if views and views > 0 else 0.0


def peak(seen, then):
    return min(seen, key=lambda r: (high(r["video_view_count"]), *(low(rating(r) if c == "rating" else r[c]) for c in then)))


def videos(rows, k=10):
    found = []
    for (country, video), seen in bundles(rows, C, V).items():
        r = peak(seen, ("video_trending_date", CAT, "video_title", "rating", CH, "video_duration"))
        n = None if country is None else len(seen)
        views = r["video_view_count"]
        found.append((country, (high(n), high(views), video), (country, r[CAT], r["video_title"], r[CH], r["video_duration"], views, rating(r), n, r["video_trending_date"])))
    return best(found, k)


def month_videos(rows):
    """``rows`` with trending_year and trending_month."""
    found = []
    for (country, year, month, video), seen in bundles(rows, C, "trending_year", "trending_month", V, needed=(C, "trending_year")).items():
        then = ("video_title", CAT, CH, "video_like_count", "video_comment_count", "video_duration")
        r = peak(seen, then)
        views = r["video_view_count"]
        shown = (country, year, month, r["video_title"], r[CAT], r[CH], views, r["video_like_count"], r["video_comment_count"], r["video_duration"], len(seen))
        found.append(((country, year, month), (-len(seen), high(views), video), shown))
    return [row[:-1] for row in best(found, 1)]


def random_rows(seed, n=300):
    rnd = random.Random(seed)
    values = {
        "video_id": list("abcdefg"),
        "video_trending_country": ["US", "DE", "JP", None],
        "video_category_id": ["Music", "News", "Gaming", "Sports", "Film", "Autos", None],
        "video_view_count": ["1", "5", "10", "100", "x", None, "0"],
        "video_like_count": ["1", "2", None, "bad"],
        "channel_title": ["c1", "c2", None],
        "video_title": ["t1", "t2", None],
        "video_trending__date": ["2024.01.05", "2024.01.20", "2024.02.01", "x", None],
    }
    return [snap_row(**{c: rnd.choice(v) for c, v in values.items()}) for _ in range(n)]
