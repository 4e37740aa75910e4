"""DataFrame -> DataFrame operators over a listing or a classified listing."""
