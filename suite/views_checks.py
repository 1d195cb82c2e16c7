"""The derived views themselves, so that every other comparison starts from equal inputs."""

from .registry import query, rnd

_DIGITS = {"track_points": ["lng", "lat"], "areas": ["lng", "lat", "half_deg", "c_lng", "c_lat"], "area_vertices": ["lng", "lat"],
           "waypoints": ["lng", "lat"], "legs": ["a_lng", "a_lat", "b_lng", "b_lat"]}
_NAMES = ["track_points", "areas", "area_vertices", "messages", "dem_cells", "visits", "wishes", "waypoints", "legs", "calls", "plans",
          "drafts", "plan_tasks", "seg_remote", "seg_installed"]


def _register(name):
    doubles = _DIGITS.get(name, [])
    sql = f"SELECT * REPLACE ({', '.join(f'round({c}, 7) AS {c}' for c in doubles)}) FROM {name}" if doubles else f"SELECT * FROM {name}"
    query(f"view_{name}", sql)(lambda v: rnd(getattr(v, name), *doubles, digits=7))


for _n in _NAMES:
    _register(_n)
