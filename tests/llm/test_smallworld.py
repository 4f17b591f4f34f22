import numpy as np

from sparkloom.llm import smallworld


def _unit(x):
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def test_walks_of_fifty_thousand_nodes_against_exhaustive_search():
    """Recall of the best match and of the ten best, on groups of related vectors, as texts have them."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(2500, 32))
    x = _unit(centre[rng.integers(0, 2500, 50000)] + 0.7 * rng.normal(size=(50000, 32)))
    q = _unit(x[::100] + 0.08 * rng.normal(size=(500, 32)))
    g = smallworld.build(x)
    node, sim = smallworld.search(x, g, q, 10)
    exact = q @ x.T
    best = np.sort(exact, 1)[:, ::-1][:, :10]
    assert (sim[:, 0] >= best[:, 0] - 1e-5).mean() >= 0.98
    assert (sim >= best[:, 9:] - 1e-5).mean() >= 0.9
    assert np.allclose(np.take_along_axis(exact, node, 1), sim, atol=1e-5)


def test_no_node_is_out_of_reach():
    """Close groups far from one another fill their links among themselves; every node is found all the same."""
    rng = np.random.default_rng(2)
    x = _unit(np.repeat(rng.normal(size=(60, 24)), 60, 0) + 1e-3 * rng.normal(size=(3600, 24)))
    g = smallworld.build(x)
    seen, front = np.zeros(len(x), bool), g.entries
    while len(front):
        seen[front] = True
        front = np.unique(g.links[front])
        front = front[front >= 0]
        front = front[~seen[front]]
    assert seen.all()
    node, _ = smallworld.search(x, g, x[::7], 1)
    assert ((x[::7] * x[node[:, 0]]).sum(1) >= 0.999).all()


def test_edges():
    none = np.zeros((0, 8), np.float32)
    g = smallworld.build(none)
    node, _ = smallworld.search(none, g, _unit(np.ones((2, 8))), 3)
    assert (node == -1).all()
    same = np.repeat(_unit(np.ones((1, 8))), 3000, 0)  # equal vectors must not make a walk turn in circles
    node, sim = smallworld.search(same, smallworld.build(same), same[:5], 4)
    assert (node >= 0).all() and np.allclose(sim, 1)
    one = smallworld.build(same[:1])
    node, _ = smallworld.search(same[:1], one, same[:2], 3)
    assert node.tolist() == [[0, -1, -1]] * 2
