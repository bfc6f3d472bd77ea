"""Sources and sinks: block listings, containers, manifests and images."""
