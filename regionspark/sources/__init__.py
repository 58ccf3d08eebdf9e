"""Reading region documents and writing binary meshes."""
