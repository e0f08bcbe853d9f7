"""Category discovery against a queue that is worked off page by page."""

import random
from collections import deque

import pytest

from marketgrain.operators.discovery import DEPTH, FALLBACKS, Recon
from marketgrain.sources import folders

ROOT = "http://{}.example"


def by_hand(roots, roles, links, levels=99):
    """Listings found, by site; pages of depth ``levels`` and more are left."""
    found = []
    for site, base in roots:
        queue, visited, own = deque([(base, 0)]), {base}, []
        while queue:
            url, depth = queue.popleft()
            role = roles.get(url)
            if depth > DEPTH or depth >= levels or role is None:
                continue
            if role == "listing" and url != base:
                own.append((site, url, depth))
            if role in ("hub", "unknown") or role == "listing" and depth < DEPTH:
                for link in links.get(url, ()):
                    if link not in visited:
                        visited.add(link)
                        queue.append((link, depth + 1))
        if not own and levels > DEPTH:
            own = [(site, base + p, None) for p in FALLBACKS if base + p not in visited and roles.get(base + p) in ("listing", "hub")]
        found += own
    return sorted(found, key=repr)


def web(seed):
    """Sites of random pages, some of them without listings, with cycles, links to no page and usual paths."""
    rng, roots, roles, links = random.Random(seed), [], {}, {}
    for k in range(12):
        base = ROOT.format(f"s{k}")
        kinds = ["hub", "unknown", "product"] + ["listing"] * (k % 3 > 0)
        urls = [base, *(f"{base}/c/{i}" for i in range(25)), *(base + p for p in FALLBACKS[:3])]
        roots.append((k, base))
        for url in urls:
            if rng.random() < 0.9:
                roles[url] = rng.choice(kinds)
            links[url] = [u for u in urls[: 26 + k % 2] if rng.random() < 0.08] + [f"{base}/gone"]
        roles[base] = "hub" if k else "listing"
    return roots, roles, links


def crawl(spark, tmp_path, roots, roles, links, name="state"):
    frames = (
        spark.createDataFrame(roots, "site long, url string"),
        spark.createDataFrame(list(roles.items()), "url string, role string"),
        spark.createDataFrame([(u, v) for u, found in links.items() for v in found], "url string, link string"),
    )
    return Recon(*frames, f"file://{tmp_path}/{name}")


def rows(df):
    return sorted(map(tuple, df.select("site", "url", "depth").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_stopped_and_resumed_equals_one_run(spark, tmp_path, seed):
    roots, roles, links = web(seed)
    whole = by_hand(roots, roles, links)
    assert any(r[2] is None for r in whole) and {r[2] for r in whole} >= {1, 2, 3}
    one, stopped = crawl(spark, tmp_path, roots, roles, links, "one").run()
    assert not stopped and rows(one) == whole
    for last in (0, 2):
        name = f"stopped-{last}"
        part, stopped = crawl(spark, tmp_path, roots, roles, links, name).run(lambda level: level == last)
        assert stopped and rows(part) == by_hand(roots, roles, links, last)
        assert crawl(spark, tmp_path, roots, roles, links, name).queued() == last
        found, stopped = crawl(spark, tmp_path, roots, roles, links, name).run()  # another object, as after a restart
        assert not stopped and rows(found) == whole
        assert crawl(spark, tmp_path, roots, roles, links, name).queued() is None


def test_a_level_that_broke_off_is_done_again(spark, tmp_path):
    roots, roles, links = web(3)
    work = crawl(spark, tmp_path, roots, roles, links)
    work.run(lambda level: level == 2)
    folders.remove(spark, f"{work.folder}/queue-2/_SUCCESS")  # its writer was lost before it ended
    assert work.queued() == 1
    assert rows(work.run()[0]) == by_hand(roots, roles, links)


def test_nothing_to_read(spark, tmp_path):
    found, stopped = crawl(spark, tmp_path, [(1, ROOT.format("none"))], {"http://x.example": "hub"}, {"http://x.example": ["http://x.example/a"]}).run()
    assert rows(found) == [] and not stopped
