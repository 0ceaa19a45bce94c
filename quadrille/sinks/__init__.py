"""Writers: features, centroids, result documents, exports, manifests."""
