"""Physical strategies: tiles with halos, flow graphs, components, bottlenecks."""
