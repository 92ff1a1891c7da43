from simplexspark.plans import aggregates, composition, panel, spatial, surface

ALL = {**panel.QUERIES, **aggregates.QUERIES, **composition.QUERIES, **spatial.QUERIES, **surface.QUERIES}
