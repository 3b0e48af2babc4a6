"""Row types. Keys: video_id, frame_idx, and for tracks scene_id, class_name, track_id."""

VIDEOS = "video_id string, url string, local_path string, fps double, width int, height int, duration_seconds double, has_audio boolean, codec string, filesize_bytes long"
FRAMES = "video_id string, frame_idx int, timestamp_ms double, width int, height int, is_scene_cut boolean, is_detection_frame boolean"
FRAME_PIXELS = "video_id string, frame_idx int, width int, height int, bgr binary"
DETECTIONS = "video_id string, frame_idx int, det_id long, class_name string, x1 int, y1 int, x2 int, y2 int, confidence double"
TRACKS = "video_id string, scene_id int, frame_idx int, class_name string, track_id long, x1 int, y1 int, x2 int, y2 int, confidence double, age int, frames_since_update int, is_confirmed boolean"
GROUND_TRUTH = "video_id string, frame_idx int, x1 int, y1 int, x2 int, y2 int, class_name string, track_id int"
ANNOTATION_FILE = "annotations array<struct<frame_idx:int,bbox:array<int>,class:string,track_id:int>>"
FACE_EMBEDDINGS = "video_id string, frame_idx int, x1 int, y1 int, x2 int, y2 int, face_size_px int, embedding_original array<float>, embedding_redacted array<float>"
CLASS_METRICS = "struct<recall:double,precision:double,f1:double,fpr:double,tp:long,fp:long,fn:long>"
EVAL_RESULTS = f"video_id string, face {CLASS_METRICS}, text {CLASS_METRICS}, logo {CLASS_METRICS}, temporal_consistency double, ssim double, fps double, reid_rate double"
