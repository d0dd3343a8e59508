from .views import PathView, delta_paths, maintain_stream, paths, rewrites

__all__ = ["PathView", "delta_paths", "maintain_stream", "paths", "rewrites"]
